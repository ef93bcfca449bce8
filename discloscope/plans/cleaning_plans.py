"""Sources, cleaning, joins and set operations as queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.functions import fixed_values as V
from discloscope.functions.exprs import clip, cut, guarded_ratio, lookup
from discloscope.operators import cleaning as C
from discloscope.plans.registry import QUERIES, case_map, clip_sql, cte, query, unpivot_sql
from discloscope.session import staging_dir
from discloscope.sources import adapters as A
from discloscope.sources import readers as R

PILLARS = ["env_risk_score", "social_risk_score", "gov_risk_score"]


def scratch(spark) -> str:
    return f"{staging_dir(spark)}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources
@query("csv_scan", cte("SELECT * FROM raw_rating", "raw_rating"), "total_score score_current score_forecast")
def csv_scan(spark, sf):
    raw = A.raw_rating(spark, sf)
    path = scratch(spark)
    R.write_csv(raw, path)
    return R.read_csv(spark, path, raw.schema)


PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


@query("scan_with_fallback", "SELECT * FROM part", "p_retailprice")
def scan_with_fallback(spark, sf):
    return R.read_first_available(spark, [f"{sf}/part_expanded.parquet", f"{sf}/part.parquet"], PART_SCHEMA)


REQUIRED = ["company_name", "sector", "industry", "description", "total_esg_risk_score", "controversy_score", *PILLARS]


@query("required_columns", cte(f"SELECT {', '.join(REQUIRED)} FROM profile", "profile"),
       "total_esg_risk_score controversy_score env_risk_score social_risk_score gov_risk_score")
def required_columns(spark, sf):
    return C.require_columns(A.profile(spark, sf), REQUIRED).select(*REQUIRED)


@query("multi_table_sink", cte("""
    SELECT 'profile' AS table_name, count(*) AS n FROM profile UNION ALL SELECT 'panel', count(*) FROM panel""",
                               "profile", "panel"))
def multi_table_sink(spark, sf):
    paths = R.write_tables({"profile": A.profile(spark, sf), "panel": A.panel(spark, sf)}, scratch(spark))
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("metrics_json_sink", cte("""
    SELECT model, split, count(*) AS n, sum(y)::BIGINT AS positives, avg(p) AS mean_p
    FROM pred_long GROUP BY model, split""", "pred_long"), "mean_p")
def metrics_json_sink(spark, sf):
    metrics = (A.predictions_long(spark, sf).groupBy("model", "split")
               .agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg("p").alias("mean_p"))
                    .alias("metrics")))
    path = scratch(spark)
    metrics.write.json(path)
    back = spark.read.json(path, schema="model string, split string, metrics struct<n:bigint,positives:bigint,mean_p:double>")
    return back.select("model", "split", "metrics.*")


REFERENCE = dt.datetime(2024, 2, 1)


@query("article_feed_parse", """
    SELECT company_id, item_no, title, source, url, published, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(published)) / 3.6e9 AS age_hours
    FROM (SELECT user_id AS company_id, event_id AS item_no, event_type || ' headline' AS title,
                 CASE WHEN event_id % 40 = 0 THEN 'Unknown' ELSE event_type END AS source, 'u' || event_id AS url,
                 CASE WHEN event_id % 50 = 0 THEN TIMESTAMP '2024-02-01' ELSE date_trunc('second', ts) END AS published FROM events WHERE event_id % 211 <> 0)""", "age_hours")
def article_feed_parse(spark, sf):
    items = R.read_feed(spark, landed_feed(spark, sf)).filter("raw IS NULL")
    return R.parse_feed(items, REFERENCE).withColumn("published", F.col("published").cast("timestamp_ntz"))


@query("article_feed_quality", """
    SELECT CASE WHEN event_id % 211 = 0 THEN 'malformed' ELSE 'parsed' END AS status, count(*) AS n FROM events GROUP BY 1""")
def article_feed_quality(spark, sf):
    """Items that were read and items that are no XML: none is lost."""
    items = R.read_feed(spark, landed_feed(spark, sf))
    return items.groupBy(F.when(F.col("raw").isNotNull(), "malformed").otherwise("parsed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def landed_feed(spark, sf) -> str:
    """Feed files rendered from the events: markup in titles, missing sources, unreadable dates, broken items."""
    e = A.table(spark, sf, "events")
    k = F.col("event_id")
    item = F.concat(
        F.lit('<item company="'), "user_id", F.lit('" no="'), k, F.lit('"><title>&lt;b&gt;'), "event_type", F.lit("&lt;/b&gt; headline</title>"),
        F.when(k % 40 != 0, F.concat(F.lit("<source>"), "event_type", F.lit("</source>"))).otherwise(""), F.lit("<link>u"), k, F.lit("</link><pubDate>"),
        F.when(k % 50 == 0, "no date").otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")),
        F.when(k % 211 == 0, "</item>").otherwise("</pubDate></item>"))  # a tag left open breaks the item
    folder = scratch(spark)
    e.select(item.alias("value")).write.text(folder)
    return folder


# ------------------------------------------------------------------ cleaning
@query("name_standardize", cte("SELECT company_id, upper(trim(name, ' ' || chr(9))) AS company_name FROM raw_rating", "raw_rating"))
def name_standardize(spark, sf):
    return A.raw_rating(spark, sf).select("company_id", C.standard_name(F.col("name")).alias("company_name"))


@query("dedup_keep_first", """
    SELECT company_name, year, company_id, score FROM (
        SELECT upper(p_name) AS company_name, CAST(2019 + p_partkey % 5 AS INTEGER) AS year, p_partkey AS company_id,
               (p_partkey % 81) / 80.0 AS score,
               row_number() OVER (PARTITION BY upper(p_name), p_partkey % 5 ORDER BY p_partkey) AS rn FROM part)
    WHERE rn = 1""", "score")
def dedup_keep_first(spark, sf):
    return C.keep_first(accusations(spark, sf), ["company_name", "year"], "company_id")


def accusations(spark, sf):
    k = F.col("p_partkey")
    return A.table(spark, sf, "part").select(
        F.upper("p_name").alias("company_name"), (k % 5 + 2019).cast("int").alias("year"), k.alias("company_id"),
        ((k % 81) / 80.0).alias("score"))


@query("drop_null_key", cte("SELECT company_id, total_score FROM raw_rating WHERE total_score IS NOT NULL", "raw_rating"), "total_score")
def drop_null_key(spark, sf):
    return A.raw_rating(spark, sf).select("company_id", "total_score").na.drop(subset=["total_score"])


@query("parse_thousands", cte("SELECT company_id, TRY_CAST(trim(replace(employees, ',', '')) AS DOUBLE) AS employees FROM raw_rating", "raw_rating"), "employees")
def parse_thousands(spark, sf):
    return A.raw_rating(spark, sf).select("company_id", C.parse_thousands(F.col("employees")).alias("employees"))


@query("ordinal_encode", cte(f"""
    SELECT company_id, {case_map('risk_level', V.RISK_LEVELS)} AS risk_code,
           {case_map('controversy_level', V.CONTROVERSY_LEVELS)} AS controversy_code,
           {case_map('exposure', V.EXPOSURE_LEVELS)} AS exposure_code,
           {case_map('management', V.MANAGEMENT_LEVELS)} AS management_code FROM raw_rating""", "raw_rating"))
def ordinal_encode(spark, sf):
    return A.raw_rating(spark, sf).select(
        "company_id", lookup(V.RISK_LEVELS, F.col("risk_level")).alias("risk_code"),
        lookup(V.CONTROVERSY_LEVELS, F.col("controversy_level")).alias("controversy_code"),
        lookup(V.EXPOSURE_LEVELS, F.col("exposure")).alias("exposure_code"),
        lookup(V.MANAGEMENT_LEVELS, F.col("management")).alias("management_code"))


@query("extract_first_number", cte(r"SELECT company_id, TRY_CAST(nullif(regexp_extract(percentile, '(\d+)', 1), '') AS DOUBLE) AS percentile FROM raw_rating", "raw_rating"), "percentile")
def extract_first_number(spark, sf):
    return A.raw_rating(spark, sf).select("company_id", C.first_number(F.col("percentile")).alias("percentile"))


@query("rename_project", cte("SELECT company_id, symbol, name AS company_name, sector, total_score AS total_esg_risk_score FROM raw_rating", "raw_rating"), "total_esg_risk_score")
def rename_project(spark, sf):
    return (A.raw_rating(spark, sf).drop("unnamed_column")
            .withColumnsRenamed({"name": "company_name", "total_score": "total_esg_risk_score"})
            .select("company_id", "symbol", "company_name", "sector", "total_esg_risk_score"))


@query("fill_constant", cte("SELECT company_id, year, coalesce(growth_rate, 0.0) AS growth_rate FROM panel", "panel"), "growth_rate")
def fill_constant(spark, sf):
    return A.panel(spark, sf).select("company_id", "year", "growth_rate").na.fill(0.0, ["growth_rate"])


def clean_profile(spark, sf):
    return C.median_impute(A.profile(spark, sf), PILLARS, A.companies(spark, sf))


def clean_companies(spark, sf):
    """The clean profile without its text."""
    return C.median_impute(A.companies(spark, sf), PILLARS)


@query("median_impute", cte("SELECT company_id, env_risk_score, social_risk_score, gov_risk_score FROM clean", "clean"), " ".join(PILLARS))
def median_impute(spark, sf):
    return clean_companies(spark, sf).select("company_id", *PILLARS)


@query("threshold_label", "SELECT p_partkey AS company_id, CASE WHEN (p_partkey % 81) / 80.0 >= 0.5 THEN 1 ELSE 0 END AS flag FROM part")
def threshold_label(spark, sf):
    return accusations(spark, sf).select("company_id", C.threshold_flag(F.col("score")).alias("flag"))


@query("bins_right_closed", """
    SELECT company_id, score, CASE WHEN score < 0 THEN NULL WHEN score <= 0.25 THEN 'Low' WHEN score <= 0.5 THEN 'Moderate'
           WHEN score <= 0.75 THEN 'High' WHEN score <= 1 THEN 'Very High' END AS band
    FROM (SELECT p_partkey AS company_id, (p_partkey % 81) / 80.0 + (CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END) AS score FROM part)""", "score")
def bins_right_closed(spark, sf):
    score = F.col("score") + F.when(F.col("company_id") % 29 == 0, 1.0).otherwise(0.0)
    return accusations(spark, sf).select("company_id", score.alias("score")).withColumn("band", C.accusation_band(F.col("score")))


@query("bins_left_closed", cte("""
    SELECT company_id,
      CASE WHEN total_esg_risk_score < 0 OR total_esg_risk_score IS NULL THEN 2 WHEN total_esg_risk_score < 10 THEN 0
           WHEN total_esg_risk_score < 20 THEN 1 WHEN total_esg_risk_score < 30 THEN 2 WHEN total_esg_risk_score < 40 THEN 3 ELSE 4 END AS total_bin,
      CASE WHEN env_risk_score < 0 OR env_risk_score IS NULL THEN 2 WHEN env_risk_score < 3 THEN 0 WHEN env_risk_score < 6 THEN 1
           WHEN env_risk_score < 10 THEN 2 WHEN env_risk_score < 15 THEN 3 ELSE 4 END AS env_bin FROM profile""", "profile"))
def bins_left_closed(spark, sf):
    return A.companies(spark, sf).select("company_id", C.total_bin(F.col("total_esg_risk_score")).alias("total_bin"),
                                       C.pillar_bin(F.col("env_risk_score")).alias("env_bin"))


@query("guarded_ratio", cte("""
    SELECT company_id, year, coalesce(carbon_emissions / nullif(revenue, 0), 0) AS carbon_intensity,
           coalesce(energy_consumption / nullif(revenue, 0), 0) AS energy_intensity,
           coalesce(carbon_emissions / nullif(water_usage, 0), 0) AS carbon_per_water FROM panel""", "panel"),
       "carbon_intensity energy_intensity carbon_per_water")
def guarded(spark, sf):
    p = A.panel(spark, sf)
    return p.select("company_id", "year", guarded_ratio(F.col("carbon_emissions"), F.col("revenue")).alias("carbon_intensity"),
                    guarded_ratio(F.col("energy_consumption"), F.col("revenue")).alias("energy_intensity"),
                    guarded_ratio(F.col("carbon_emissions"), F.col("water_usage")).alias("carbon_per_water"))


@query("rowwise_spread", cte("SELECT company_id, greatest(env_risk_score, social_risk_score, gov_risk_score) - least(env_risk_score, social_risk_score, gov_risk_score) AS spread FROM profile", "profile"), "spread")
def rowwise_spread(spark, sf):
    return A.companies(spark, sf).select("company_id", C.spread([F.col(c) for c in PILLARS]).alias("spread"))


@query("column_delta", cte("SELECT company_id, score_forecast - score_current AS delta FROM raw_rating", "raw_rating"), "delta")
def column_delta(spark, sf):
    return A.raw_rating(spark, sf).select("company_id", (F.col("score_forecast") - F.col("score_current")).alias("delta"))


def dirty(spark, sf):
    k, v = F.col("company_id"), F.col("total_esg_risk_score")
    bad = F.when(k % 13 == 0, F.lit(float("inf"))).when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(float("-inf")))
    return A.companies(spark, sf).select(
        "company_id", bad.when(k % 23 == 0, F.lit(None)).otherwise(v).alias("total_value"), F.col("env_risk_score").alias("env_value"))


@query("scrub_nonfinite", cte("""
    SELECT company_id, CASE WHEN company_id % 13 = 0 OR company_id % 17 = 0 OR company_id % 19 = 0 OR company_id % 23 = 0 THEN 0
           ELSE total_esg_risk_score END AS total_value, coalesce(env_risk_score, 0) AS env_value FROM profile""", "profile"), "total_value env_value")
def scrub_nonfinite(spark, sf):
    return C.scrub_nonfinite(dirty(spark, sf), ["total_value", "env_value"])


@query("scrub_nonfinite_counts", cte("""
    SELECT 'total_value' AS "column",
           count(*) FILTER (WHERE company_id % 13 = 0 OR (company_id % 17 <> 0 AND company_id % 19 = 0)) AS n_infinite,
           count(*) FILTER (WHERE company_id % 13 <> 0 AND (company_id % 17 = 0 OR (company_id % 19 <> 0 AND company_id % 23 = 0))) AS n_missing FROM profile
    UNION ALL SELECT 'env_value', 0, count(*) FILTER (WHERE env_risk_score IS NULL) FROM profile""", "profile"))
def scrub_counts(spark, sf):
    return C.nonfinite_counts(dirty(spark, sf), ["total_value", "env_value"])


@query("grade_proxy", cte(f"""
    SELECT supplier_id, {case_map('total_grade', V.GRADE_CONTROVERSY, '2')} AS controversy_proxy,
           {case_map('total_grade', V.GRADE_RISK, '2')} AS esg_risk_level_proxy FROM graded""", "graded"))
def grade_proxy(spark, sf):
    return C.grade_levels(A.graded_rating(spark, sf), "total_grade").select("supplier_id", "controversy_proxy", "esg_risk_level_proxy")


@query("inverted_rescale", cte("SELECT supplier_id, " + ", ".join(
    clip_sql(f"50 - ({c} - {lo}) / ({hi} - {lo}) * 50", 0, 50) + f" AS {c}_normalized" for c, (lo, hi) in V.SCORE_RANGES.items())
    + " FROM graded", "graded"), " ".join(f"{c}_normalized" for c in V.SCORE_RANGES))
def inverted_rescale(spark, sf):
    return C.inverted_rescale(A.graded_rating(spark, sf), V.SCORE_RANGES).select("supplier_id", *[f"{c}_normalized" for c in V.SCORE_RANGES])


@query("entity_filter", cte("SELECT company_id, sector, total_esg_risk_score FROM profile WHERE sector = 'ECONOMY' AND total_esg_risk_score BETWEEN 10 AND 30", "profile"), "total_esg_risk_score")
def entity_filter(spark, sf):
    df = A.companies(spark, sf).select("company_id", "sector", "total_esg_risk_score")
    return C.entity_filter(df, sector="ECONOMY", low=10, high=30, score="total_esg_risk_score")


@query("clip", cte(f"SELECT company_id, {clip_sql('controversy_score - 1', 0, 4)} AS c, {clip_sql('env_risk_score', 2, 15)} AS e FROM profile", "profile"), "c e")
def clip_query(spark, sf):
    return A.companies(spark, sf).select("company_id", clip(F.col("controversy_score") - 1, 0, 4).alias("c"), clip(F.col("env_risk_score"), 2, 15).alias("e"))


@query("key_lookup_fill", cte("""
    SELECT supplier_id, coalesce(s, 'Unknown') AS sector
    FROM graded LEFT JOIN (SELECT upper(industry) AS k, arg_max(sector, company_id) AS s FROM profile GROUP BY 1) ON upper(graded.industry) = k""", "graded", "profile"))
def key_lookup_fill(spark, sf):
    known = A.companies(spark, sf).select("company_id", "industry", "sector")
    return C.key_lookup_fill(A.graded_rating(spark, sf), known, "industry", "sector", "company_id", "Unknown").select("supplier_id", "sector")


def padded(spark, sf):
    p = A.companies(spark, sf).select("company_id", "total_esg_risk_score", *PILLARS, "controversy_score")
    return p.withColumns({"always_seven": F.lit(7.0), "never_known": F.lit(None).cast("double"),
                          "env_copy": F.col("env_risk_score"), "total_copy": F.col("total_esg_risk_score") + 0.0,
                          "gov_shift": F.col("gov_risk_score") + 1.0})


PADDED = ["total_esg_risk_score", *PILLARS, "controversy_score", "always_seven", "never_known", "env_copy", "total_copy", "gov_shift"]
PADDED_SQL = "padded AS (SELECT *, 7.0 AS always_seven, NULL::DOUBLE AS never_known, env_risk_score AS env_copy, total_esg_risk_score AS total_copy, gov_risk_score + 1 AS gov_shift FROM profile)"


@query("column_profile_quality", cte(", " + PADDED_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant FROM padded" for c in PADDED), "profile"))
def column_profile_quality(spark, sf):
    return C.constant_columns(padded(spark, sf), PADDED)


@query("duplicate_columns", cte(", " + PADDED_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS kept, '{b}' AS dropped, count(*) FILTER (WHERE {a} IS DISTINCT FROM {b}) AS diff FROM padded"
    for i, a in enumerate(PADDED) for b in PADDED[i + 1:]) + ") WHERE diff = 0", "profile"))
def duplicate_columns(spark, sf):
    pairs = C.duplicate_columns(padded(spark, sf), "company_id", PADDED)
    return spark.createDataFrame([(a, b, 0) for a, b in pairs], "kept string, dropped string, diff long")


@query("expanded_impute_from_base", cte("""
    , f AS (SELECT company_id, source, CAST(length(description) AS DOUBLE) AS text_length,
                   CAST(length(description) - length(replace(description, 'a', '')) AS DOUBLE) AS letter_hits FROM profile)
    SELECT company_id, source,
           CASE WHEN source = 'B' THEN (SELECT quantile_cont(text_length, 0.5) FROM f WHERE source = 'A') ELSE text_length END AS text_length,
           CASE WHEN source = 'B' THEN (SELECT quantile_cont(letter_hits, 0.5) FROM f WHERE source = 'A') ELSE letter_hits END AS letter_hits FROM f""",
                                      "profile"), "text_length letter_hits")
def expanded_impute_from_base(spark, sf):
    d = F.col("description")
    size = F.char_length(d)
    df = A.profile(spark, sf).select("company_id", "source", size.cast("double").alias("text_length"),
                                     (size - F.char_length(F.replace(d, F.lit("a"), F.lit("")))).cast("double").alias("letter_hits"))
    return C.impute_from_base(df, ["text_length", "letter_hits"], F.col("source") == "B", F.col("source") == "A")
