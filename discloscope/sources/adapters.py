"""Maps the star-schema tables to the input contracts (profile, panel, articles, predictions, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloscope.functions.exprs import total

# one sentence per text rule; row i extends documents whose id leaves remainder i
SEED_SENTENCES = [
    "We reduced carbon emissions by 25% compared to the 2019 baseline, verified by an independent auditor in 2023.",
    "We will reach net-zero by 2040 and plan to expand solar power.",
    "Our eco-friendly journey is world-class, pioneering and committed to a better future.",
    "Our employee safety program supports communities and workplace health.",
    "Board oversight follows the TCFD framework and reporting under GRI standards is audited annually.",
    "We achieved waste reduction last year and will target recycling growth by 2030.",
    "Water recycling and renewable energy investment reduced costs by 3.5 million in fiscal year 2022.",
    "Growth was not excellent, and extremely harmful pollution led to a lawsuit and a scandal.",
    "Acme Inc. The company, see https://example.org/a?b=1, sells <b>12</b> products. Revenue was $5 million in Q3 2021.",
    "We deny the allegations as misleading and are proud to announce an award-winning milestone!",
    "The advisory group met the mayor about maybe clearer measurements, could they possibly strive?",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """Text work is CPU-bound: rows of a scan with too few splits to keep the cores busy are spread by key.

    Inputs of any size have far more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if scan.rdd.getNumPartitions() < 4 * cores else df


def seed_sentence(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEED_SENTENCES]), (key % 12 + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a seeded closing sentence, so that every text rule has hits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, docs, "doc_id").select(
        "doc_id", "lang", "source",
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), seed_sentence(F.col("doc_id"))).alias("description"))


def _company(described: Column | None) -> list[Column]:
    """Profile columns from ``part``, with the description where the text is at hand."""
    pk = F.col("p_partkey")
    second = pk % 10 == 0

    def pillar(mult: int, mod: int) -> Column:
        return F.when(~second, (pk * mult % mod) / 10.0)

    size = F.col("p_size").cast("double")
    return [
        pk.alias("company_id"),
        F.concat(F.lit("SYM"), pk).alias("symbol"),
        F.upper(F.concat("p_name", F.lit("-"), pk)).alias("company_name"),
        F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"),
        *([] if described is None else [described.alias("description")]),
        F.when(pk % 97 == 0, size * 4).otherwise(size).alias("total_esg_risk_score"),
        pillar(7919, 200).alias("env_risk_score"),
        pillar(104729, 180).alias("social_risk_score"),
        pillar(1299709, 150).alias("gov_risk_score"),
        (pk % 5 + 1).cast("double").alias("controversy_score"),
        F.when(second, "B").otherwise("A").alias("source"),
    ]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile without its text: one narrow scan, no join."""
    return table(spark, sf_dir, "part").select(*_company(None))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company, before imputation (pillars are NULL for source ``B``)."""
    pk = F.col("p_partkey")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    described = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), seed_sentence(pk))
    out = table(spark, sf_dir, "part").join(docs, pk == F.col("doc_id"), "left").select(
        *_company(F.when(F.col("text").isNotNull() | (pk % 10 != 9), described)))
    return spread(out, docs, "company_id")


def material_issues(df: DataFrame) -> DataFrame:
    """Three optional issue columns keyed on the company id."""
    k = F.col("company_id")
    return df.select(
        "*",
        F.when(k % 3 == 0, "Carbon - Own Operations").when(k % 3 == 1, "Business Ethics").alias("material_issue_1"),
        F.when(k % 4 == 0, "Human Capital").when(k % 4 == 1, "Corporate Governance").alias("material_issue_2"),
        F.when(k % 5 == 0, "Occupational Health").alias("material_issue_3"))


def raw_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as they arrive: padded names, thousands separators, level labels."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat("p_name", F.lit("-"), k)
    return table(spark, sf_dir, "part").select(
        k.alias("company_id"),
        F.when(k % 2 == 1, F.concat(F.lit("  "), F.lower(name), F.lit("\t"))).otherwise(name).alias("name"),
        F.concat(F.lit("SYM"), k).alias("symbol"), F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"),
        F.when(k % 50 == 0, "n/a").otherwise(F.format_number(k * 37, 0)).alias("employees"),
        F.when(k % 33 == 0, "none").otherwise(F.concat((k % 100).cast("string"), F.lit("th percentile"))).alias("percentile"),
        F.when(size < 10, "Negligible").when(size < 20, "Low").when(size < 30, "Medium").when(size < 40, "High")
        .when(size < 50, "Severe").otherwise("Unrated").alias("risk_level"),
        F.element_at(F.array(*[F.lit(x) for x in (
            "None Controversy Level", "Low Controversy Level", "Moderate Controversy Level",
            "Significant Controversy Level", "High Controversy Level", "Severe Controversy Level", "Other")]),
            (k % 7 + 1).cast("int")).alias("controversy_level"),
        F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (k % 3 + 1).cast("int")).alias("exposure"),
        F.element_at(F.array(F.lit("Weak"), F.lit("Average"), F.lit("Strong"), F.lit("n/a")),
                     (k % 4 + 1).cast("int")).alias("management"),
        F.when(k % 11 != 0, size.cast("double")).alias("total_score"),
        size.cast("double").alias("score_current"), (size + k % 7).cast("double").alias("score_forecast"),
    )


def graded_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: higher is better, letter grades; a third of the tickers are already known."""
    k = F.col("s_suppkey")
    grades = F.array(*[F.lit(g) for g in ("A", "AA", "BBB", "BB", "B", "C", "N/A")])
    return table(spark, sf_dir, "supplier").select(
        k.alias("supplier_id"),
        F.when(k % 3 == 0, F.concat(F.lit(" sym"), k)).otherwise(F.concat(F.lit("NEW"), k)).alias("ticker"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("brand#"), (k % 27).cast("string")).alias("industry"),
        F.element_at(grades, (k % 7 + 1).cast("int")).alias("total_grade"),
        (150 + k * 31 % 600).cast("double").alias("environment_score"),
        (100 + k * 47 % 620).cast("double").alias("social_score"),
        (50 + k * 13 % 450).cast("double").alias("governance_score"),
        (500 + k * 71 % 1100).cast("double").alias("total_score"),
    )


def panel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-year measures before growth; the aggregation combines map-side."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.col("l_quantity")
    return joined.groupBy("o_custkey", "year").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
        F.round(1000 * F.avg("l_discount"), 6).alias("esg_environmental"),
        F.round(1250 * F.avg("l_tax"), 6).alias("esg_social"),
        F.round(2 * F.avg(q), 6).alias("esg_governance"),
        F.sum(q).alias("carbon_emissions"),
        F.round(F.sum(q * F.col("l_tax")), 4).alias("water_usage"),
        F.count(F.lit(1)).cast("double").alias("energy_consumption"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company-year with lagged growth. A company has at most one row per calendar year."""
    from pyspark.sql import Window
    by_company = Window.partitionBy("o_custkey").orderBy("year")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    pillars = [F.col("esg_environmental"), F.col("esg_social"), F.col("esg_governance")]
    growth = F.col("revenue") / F.lag("revenue").over(by_company) - 1
    return (panel_totals(spark, sf_dir)
            .withColumn("growth_rate", growth)
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company_name"),
                    F.col("c_mktsegment").alias("industry"), F.col("r_name").alias("region"), "year", "revenue",
                    "growth_rate", (total(pillars) / 3.0).alias("esg_overall"),
                    "esg_environmental", "esg_social", "esg_governance",
                    "carbon_emissions", "water_usage", "energy_consumption"))


HEADLINES = [
    "{} reports strong growth, sustainable progress and an award",
    "{} faces lawsuit and fraud investigation after toxic spill",
    "{} renewable partnership shadowed by pollution penalty",
    "{} schedules annual meeting",
]


def articles(events: DataFrame) -> DataFrame:
    """Headlines from an event table or stream (same columns either way); every event is an article with a URL of its own."""
    slot = (F.col("event_id") % 4 + 1).cast("int")
    template = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), slot)
    return events.select(
        F.col("user_id").alias("company_id"), F.col("event_id").alias("article_id"), F.col("ts").cast("timestamp").alias("published"),
        F.col("event_type").alias("source"),
        F.concat_ws("/", F.lit("u"), F.col("user_id"), F.col("event_id")).alias("url"),
        F.replace(template, F.lit("{}"), F.initcap("event_type")).alias("title"))


def deliveries(articles: DataFrame) -> DataFrame:
    """The same articles as a feed delivers them: one in fifty comes twice."""
    twice = F.when(F.col("article_id") % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return articles.withColumn("_n", F.explode(twice)).drop("_n")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores of two classifiers, split 3/1/1 by id."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        k.alias("id"), F.col("quality").cast("int").alias("y"),
        ((F.col("n_chars") % 97) / 96.0).alias("p1"), ((k * 37 % 101) / 100.0).alias("p2"),
        ((k * 53 % 89) / 88.0).alias("p3"),
        F.when(k % 5 < 3, "train").when(k % 5 == 3, "val").otherwise("test").alias("split"))


def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = predictions(spark, sf_dir)
    return wide.unpivot(["id", "y", "split"], ["p1", "p2", "p3"], "model", "p")


NUMERIC_FEATURES = ["total_esg_risk_score", "env_risk_score", "social_risk_score", "gov_risk_score", "controversy_score"]
COEFFICIENTS = {"total_esg_risk_score": -0.04, "env_risk_score": 0.05, "social_risk_score": 0.03,
                "gov_risk_score": -0.02, "controversy_score": 0.9}
