"""Joins, aggregates, windows, reshaping and rules as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloscope.functions import ranking as RK
from discloscope.functions.exprs import with_globals
from discloscope.operators import categorical as K
from discloscope.operators import cleaning as C
from discloscope.operators import labels as L
from discloscope.operators import nlp as N
from discloscope.operators import numeric as M
from discloscope.operators import relational as R
from discloscope.operators import rules as U
from discloscope.plans import text_plans  # noqa: F401  (registers the claim CTEs)
from discloscope.plans.cleaning_plans import PADDED, PADDED_SQL, PILLARS, accusations, clean_companies, padded, scratch
from discloscope.plans.feature_plans import labelled, scored, score_inputs
from discloscope.plans.registry import CTES, cte, query, text, text_list, unpivot_sql
from discloscope.session import materialize
from discloscope.sources import adapters as A
from discloscope.sources import readers as RD

T = "total_esg_risk_score"


# ------------------------------------------------------------------ joins and set operations
@query("union_profiles", cte("""
    SELECT symbol AS key, name, sector, total_score, 'A' AS source FROM raw_rating
    UNION ALL SELECT ticker, name, NULL, total_score, 'B' FROM graded""", "raw_rating", "graded"), "total_score")
def union_profiles(spark, sf):
    a = A.raw_rating(spark, sf).select(F.col("symbol").alias("key"), "name", "sector", "total_score")
    b = A.graded_rating(spark, sf).select(F.col("ticker").alias("key"), "name", "total_score")
    return R.union_tagged({"A": a, "B": b})


MEASURES = ["revenue", "growth_rate", "esg_overall", "carbon_emissions", "water_usage", "energy_consumption"]


@query("left_join_latest", cte(f"""
    SELECT company_id, avg(esg_overall) AS esg_overall_mean, arg_max(esg_overall, year) AS esg_overall_latest FROM panel GROUP BY company_id""", "panel"),
       "esg_overall_mean esg_overall_latest")
def left_join_latest(spark, sf):
    p = A.panel(spark, sf)
    means = p.groupBy("company_id").agg(F.avg("esg_overall").alias("esg_overall_mean"))
    return means.join(R.latest_per_entity(p, "company_id", ["esg_overall"]), "company_id", "left")


@query("left_join_group_stats", cte(f"SELECT company_id, avg({T}) OVER s AS esg_sector_mean, stddev_samp({T}) OVER s AS esg_sector_std, avg(controversy_score) OVER s AS controversy_sector_mean FROM profile WINDOW s AS (PARTITION BY sector)", "profile"),
       "esg_sector_mean esg_sector_std controversy_sector_mean")
def left_join_group_stats(spark, sf):
    df = A.companies(spark, sf).select("company_id", "sector", T, "controversy_score")
    return RK.attach_group(df, M.group_stats(df), ["sector"]).select("company_id", "esg_sector_mean", "esg_sector_std", "controversy_sector_mean")


@query("stats_plus_ratio", cte("SELECT company_id, avg(high_risk_flag) OVER s AS sector_high_risk_ratio, count(*) OVER s AS sector_company_count FROM bins WINDOW s AS (PARTITION BY sector)", "bins"), "sector_high_risk_ratio")
def stats_plus_ratio(spark, sf):
    df = K.risk_bins(A.companies(spark, sf))
    stats = K.group_profile(df).select("sector", "sector_high_risk_ratio", "sector_company_count")
    return RK.attach_group(df, stats, ["sector"]).select("company_id", "sector_high_risk_ratio", "sector_company_count")


@query("enrich_predictions", cte(f"SELECT company_id, {T}, quality, toxic FROM profile LEFT JOIN labels ON doc_id = company_id", "profile"), T)
def enrich_predictions(spark, sf):
    labels = A.table(spark, sf, "labels").withColumnRenamed("doc_id", "company_id")
    return R.enrich(A.companies(spark, sf).select("company_id", T), labels, "company_id", [T, "quality", "toxic"])


@query("anti_join_new_entities", cte("SELECT supplier_id, ticker FROM graded WHERE upper(trim(ticker)) NOT IN (SELECT upper(trim(symbol)) FROM profile)", "graded", "profile"))
def anti_join_new_entities(spark, sf):
    return R.new_entities(A.graded_rating(spark, sf), A.companies(spark, sf), "ticker", "symbol").select("supplier_id", "ticker")


@query("key_intersection", cte("SELECT upper(trim(ticker)) AS key FROM graded INTERSECT SELECT upper(trim(symbol)) FROM profile", "graded", "profile"))
def key_intersection(spark, sf):
    return R.shared_keys(A.graded_rating(spark, sf), A.companies(spark, sf), "ticker", "symbol")


@query("multi_entity_assemble", cte(f"SELECT p.company_id, sector, {T}, quality FROM profile p JOIN labels ON doc_id = p.company_id WHERE controversy_score = 5", "profile"), T)
def multi_entity_assemble(spark, sf):
    """Entities listed in one table, kept only when present in both others."""
    p = A.profile(spark, sf)
    wanted = p.filter(F.col("controversy_score") == 5).select("company_id")
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("company_id"), "quality")
    return p.select("company_id", "sector", T).join(labels, "company_id").join(wanted, "company_id", "left_semi")


@query("year_gap_join", cte("SELECT company_id, year, esg_overall - avg(esg_overall) OVER (PARTITION BY industry, year) AS gap FROM panel", "panel"), "gap")
def year_gap_join(spark, sf):
    p = A.panel(spark, sf).select("company_id", "industry", "year", "esg_overall")
    means = p.groupBy("industry", "year").agg(F.avg("esg_overall").alias("m"))
    return RK.attach_group(p, means, ["industry", "year"]).select("company_id", "year", (F.col("esg_overall") - F.col("m")).alias("gap"))


@query("metrics_delta_join", cte("""
    SELECT n.model, n.acc AS new_acc, n.acc - o.acc AS delta, CASE WHEN o.acc IS NULL THEN 'N/A' ELSE 'known' END AS status
    FROM (SELECT model, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS acc FROM pred_long WHERE split = 'test' GROUP BY model) n
    LEFT JOIN (SELECT model, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS acc FROM pred_long WHERE split = 'val' AND model <> 'p3' GROUP BY model) o USING (model)""", "pred_long"), "new_acc delta")
def metrics_delta_join(spark, sf):
    p = A.predictions_long(spark, sf)
    acc = F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))
    new = p.filter("split = 'test'").groupBy("model").agg(acc.alias("new_acc"))
    old = p.filter("split = 'val' and model <> 'p3'").groupBy("model").agg(acc.alias("old_acc"))
    return new.join(old, "model", "left").select("model", "new_acc", (F.col("new_acc") - F.col("old_acc")).alias("delta"),
                                                 F.when(F.col("old_acc").isNull(), "N/A").otherwise("known").alias("status"))


@query("scalar_broadcast", cte(f"SELECT company_id, CASE WHEN {T} > (SELECT avg({T}) + stddev_samp({T}) FROM profile) THEN 1 ELSE 0 END AS high FROM profile", "profile"))
def scalar_broadcast(spark, sf):
    df = A.companies(spark, sf).select("company_id", T)
    out = with_globals(df, M.population_moments(df, [T]), "_m")
    return out.select("company_id", (F.col(T) > F.col(f"_m.{T}_mean") + F.col(f"_m.{T}_std")).cast("int").alias("high"))


@query("label_highlight", cte("SELECT company_id, CASE WHEN industry IN ('Brand#1', 'Brand#7') THEN industry ELSE 'Other' END AS label FROM profile", "profile"))
def label_highlight(spark, sf):
    c = F.col("industry")
    return A.companies(spark, sf).select("company_id", F.when(c.isin("Brand#1", "Brand#7"), c).otherwise("Other").alias("label"))


# ------------------------------------------------------------------ aggregations
PANEL_COLS = [c for c in R.PANEL_MEASURES if c not in ("profit_margin", "market_cap")]


@query("panel_aggregate", cte("SELECT company_id, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in PANEL_COLS) + " FROM panel GROUP BY company_id", "panel"),
       " ".join(f"{c}_{s}" for c in PANEL_COLS for s in ("mean", "std", "min", "max")), 4)
def panel_aggregate(spark, sf):
    return R.panel_aggregate(A.panel(spark, sf))


@query("latest_per_entity", cte("SELECT company_id, arg_max(revenue, year) AS revenue_latest, arg_max(growth_rate, year) FILTER (WHERE growth_rate IS NOT NULL) AS growth_rate_latest FROM panel GROUP BY company_id", "panel"), "revenue_latest growth_rate_latest")
def latest_per_entity(spark, sf):
    return R.latest_per_entity(A.panel(spark, sf), "company_id", ["revenue", "growth_rate"])


@query("trend_volatility", cte("SELECT company_id, " + ", ".join(
    f"coalesce(arg_max({c}, year) FILTER (WHERE {c} IS NOT NULL) - avg({c}), 0) AS {c}_trend, coalesce(stddev_samp({c}) / nullif(avg({c}), 0), 0) AS {c}_volatility"
    for c in ("esg_overall", "carbon_emissions")) + " FROM panel GROUP BY company_id", "panel"),
       "esg_overall_trend esg_overall_volatility carbon_emissions_trend carbon_emissions_volatility")
def trend_volatility(spark, sf):
    return R.trend_volatility(A.panel(spark, sf), "company_id", ["esg_overall", "carbon_emissions"])


@query("group_stats", cte(f"SELECT sector, avg({T}) AS esg_sector_mean, coalesce(stddev_samp({T}), 0) AS esg_sector_std, avg(controversy_score) AS controversy_sector_mean FROM profile GROUP BY sector", "profile"),
       "esg_sector_mean esg_sector_std controversy_sector_mean")
def group_stats(spark, sf):
    return M.group_stats(A.companies(spark, sf))


GP = ["sector_avg_esg", "sector_avg_controversy", "sector_max_esg", "sector_min_esg", "sector_company_count", "sector_esg_spread", "sector_high_risk_ratio"]


@query("group_profile", cte(f"SELECT DISTINCT sector, {', '.join(GP)} FROM cat", "cat"), " ".join(g for g in GP if g != "sector_company_count"))
def group_profile(spark, sf):
    return K.group_profile(K.risk_bins(A.companies(spark, sf)))


TIER_VALUES = "(VALUES (0, 'Very Low Risk'), (1, 'Low Risk'), (2, 'Moderate Risk'), (3, 'High Risk'), (4, 'Very High Risk')) AS d(tier_order, risk_tier)"


@query("tier_distribution", cte(f"SELECT d.risk_tier, tier_order, count(company_id) AS n, count(company_id) / (SELECT count(*) FROM scored) * 100 AS pct FROM {TIER_VALUES} LEFT JOIN scored USING (risk_tier) GROUP BY ALL", "scored"), "pct")
def tier_distribution(spark, sf):
    return R.tier_distribution(scored(spark, sf))


@query("sector_summary", cte("SELECT sector, avg(risk_score) AS mean_score, max(risk_score) AS max_score, min(risk_score) AS min_score, count(*) AS n FROM scored GROUP BY sector", "scored"), "mean_score max_score min_score")
def sector_summary(spark, sf):
    return R.sector_summary(scored(spark, sf))


@query("portfolio_summary", cte("SELECT sector, count(*) AS companies, round_even(avg(risk_score), 2) AS mean_score, round_even(max(risk_score), 2) AS max_score, count(*) FILTER (WHERE risk_score >= 60) AS high_risk FROM scored GROUP BY sector", "scored"), "mean_score max_score")
def portfolio_summary(spark, sf):
    return R.portfolio_summary(scored(spark, sf))


@query("kpi_block", cte("SELECT count(*) AS n, avg(risk_score) AS mean_score, count(*) FILTER (WHERE risk_score >= 60) AS high, max(risk_score) AS max_score, quantile_cont(risk_score, 0.5) AS median_score FROM scored", "scored"), "mean_score max_score median_score")
def kpi_block(spark, sf):
    df = scored(spark, sf)
    median = RK.column_quantiles(df, ["risk_score"], {"median": 0.5})["risk_score_median"]
    s = F.col("risk_score")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"), F.count_if(s >= 60).alias("high"), F.max(s).alias("max_score")) \
        .withColumn("median_score", F.lit(median))


@query("band_counts", cte("SELECT count(*) FILTER (WHERE risk_score >= 60) AS high, count(*) FILTER (WHERE risk_score >= 40 AND risk_score < 60) AS moderate, count(*) FILTER (WHERE risk_score < 40) AS low FROM scored", "scored"))
def band_counts(spark, sf):
    s = F.col("risk_score")
    return scored(spark, sf).agg(F.count_if(s >= 60).alias("high"), F.count_if((s >= 40) & (s < 60)).alias("moderate"), F.count_if(s < 40).alias("low"))


@query("industry_year_average", cte("SELECT industry, year, avg(esg_overall) AS esg_overall, avg(carbon_emissions) AS carbon_emissions, avg(revenue) AS revenue FROM panel GROUP BY industry, year", "panel"), "esg_overall carbon_emissions revenue", 4)
def industry_year_average(spark, sf):
    return A.panel(spark, sf).groupBy("industry", "year").agg(*[F.avg(c).alias(c) for c in ("esg_overall", "carbon_emissions", "revenue")])


@query("robust_stats", cte(f"SELECT quantile_cont({T}, 0.25) AS q1, quantile_cont({T}, 0.5) AS med, quantile_cont({T}, 0.75) AS q3, mad({T}) AS mad, quantile_cont({T}, 0.75) - quantile_cont({T}, 0.25) AS iqr FROM profile", "profile"), "q1 med q3 mad iqr")
def robust_stats(spark, sf):
    r = M.robust_stats(A.companies(spark, sf).select(T), [T])
    row = [r[f"{T}_{k}"] for k in ("q1", "med", "q3", "mad")]
    return spark.createDataFrame([(*row, row[2] - row[0])], "q1 double, med double, q3 double, mad double, iqr double")


@query("population_moments", cte(f"SELECT avg({T}) AS {T}_mean, stddev_samp({T}) AS {T}_std, avg(controversy_score) AS controversy_score_mean, stddev_samp(controversy_score) AS controversy_score_std FROM profile", "profile"),
       f"{T}_mean {T}_std controversy_score_mean controversy_score_std")
def population_moments(spark, sf):
    return M.population_moments(A.companies(spark, sf))


CORR = [T, *PILLARS, "controversy_score", "env_copy", "gov_shift"]


@query("correlation_pairs", cte(", " + PADDED_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM padded" for i, a in enumerate(CORR) for b in CORR[i + 1:]) + ") WHERE abs(r) > 0.98", "profile"), "r")
def correlation_pairs(spark, sf):
    return R.correlation_pairs(padded(spark, sf), CORR, above=0.98)


CM = [T, *PILLARS, "controversy_score"]


@query("correlation_matrix", cte(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS r FROM clean" for a in CM for b in CM if a != b)
                                 + "".join(f" UNION ALL SELECT '{a}', '{a}', 1.0" for a in CM), "clean"), "r")
def correlation_matrix(spark, sf):
    return R.correlation_matrix(materialize(clean_companies(spark, sf).select(*CM)), CM)


REG = [*M.FEATURES["pillar_ratios"], *M.FEATURES["risk_decomposition"]]
DECLARED = [(f, "numerical", g) for g in ("pillar_ratios", "risk_decomposition") for f in M.FEATURES[g]] + [("dropped_feature", "numerical", "none")]


@query("feature_registry", cte(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, 'numerical' AS module, '{g}' AS category, 'double' AS dtype, avg({f}) AS mean, stddev_samp({f}) AS std, min({f}) AS min, max({f}) AS max, count(*) - count({f}) AS null_count FROM num2"
    for f, _, g in DECLARED[:-1]) + " UNION ALL SELECT 'dropped_feature', 'numerical', 'none', 'removed', NULL, NULL, NULL, NULL, NULL", "num2"), "mean std min max", 4)
def feature_registry(spark, sf):
    df = M.risk_decomposition(M.pillar_ratios(materialize(clean_companies(spark, sf))))
    return R.feature_registry(df, spark.createDataFrame(DECLARED, "feature string, module string, category string"))


@query("histogram", cte(f"""
    SELECT CAST(CASE WHEN hi > lo THEN least(floor(({T} - lo) / ((hi - lo) / 25.0)), 24) ELSE 0 END AS INTEGER) AS bin, count(*) AS n,
           any_value(lo) + CAST(CASE WHEN any_value(hi) > any_value(lo) THEN least(floor((any_value({T}) - any_value(lo)) / ((any_value(hi) - any_value(lo)) / 25.0)), 24) ELSE 0 END AS INTEGER) * ((any_value(hi) - any_value(lo)) / 25.0) AS bin_start
    FROM profile, (SELECT min({T}) AS lo, max({T}) AS hi FROM profile) GROUP BY 1""", "profile"), "bin_start")
def histogram(spark, sf):
    return R.histogram(A.companies(spark, sf).select(T), T, 25)


@query("group_quartiles", cte(f"SELECT sector, min({T}) AS min, quantile_cont({T}, 0.25) AS q1, quantile_cont({T}, 0.5) AS median, quantile_cont({T}, 0.75) AS q3, max({T}) AS max FROM profile GROUP BY sector", "profile"), "min q1 median q3 max")
def group_quartiles(spark, sf):
    return C.group_quartiles(A.companies(spark, sf).select("sector", T), "sector", T)


@query("proxy_distribution", cte("SELECT CAST(v AS INTEGER) AS gw_proxy_score, count(company_id) AS n, count(company_id) / (SELECT count(*) FROM labelled) * 100 AS pct FROM (SELECT unnest(range(0, 6)) AS v) LEFT JOIN labelled ON gw_proxy_score = v GROUP BY v", "labelled"), "pct")
def proxy_distribution(spark, sf):
    return R.value_distribution(labelled(spark, sf)[0], "gw_proxy_score", range(6))


@query("distinct_summary", """
    SELECT count(DISTINCT upper(p_name)) AS companies, CAST(min(2019 + p_partkey % 5) AS INTEGER) AS first_year, CAST(max(2019 + p_partkey % 5) AS INTEGER) AS last_year,
           count(*) FILTER (WHERE (p_partkey % 81) / 80.0 >= 0.5) AS accused, count(*) FILTER (WHERE p_partkey IS NULL) AS null_scores FROM part""")
def distinct_summary(spark, sf):
    a = accusations(spark, sf)
    return a.agg(F.count_distinct("company_name").alias("companies"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                 F.count_if(F.col("score") >= 0.5).alias("accused"), F.count_if(F.col("score").isNull()).alias("null_scores"))


@query("high_indicator_count", cte("SELECT company_id, CAST(gw_indicator_1 + gw_indicator_2 + gw_indicator_4 + gw_indicator_5 AS BIGINT) AS high FROM flags", "flags"))
def high_indicator_count(spark, sf):
    df = score_inputs(spark, sf)
    cols = list(L.QUANTILE_INDICATORS.values())
    limits = L.thresholds(df)
    table = U.indicator_table(df, {c: limits[f"{c}_p75"] for c in cols}, cols)
    return table.groupBy("company_id").agg(F.count_if(F.col("status") == "HIGH").alias("high"))


# ------------------------------------------------------------------ windows, ranking, top-k
@query("percentile_rank", cte(f"SELECT company_id, (rank() OVER (ORDER BY {T}) + (count(*) OVER (PARTITION BY {T}) - 1) / 2.0) / count(*) OVER () AS pct_rank FROM profile", "profile"), "pct_rank")
def percentile_rank(spark, sf):
    df = A.companies(spark, sf).select("company_id", T)
    return RK.with_value_ranks(df, [], T).select("company_id", RK.average_percentile().alias("pct_rank"))


@query("ranked_output", cte("SELECT row_number() OVER (ORDER BY risk_score DESC, company_name) AS rank, company_name, sector, risk_score, risk_tier FROM scored", "scored"), "risk_score")
def ranked_output(spark, sf):
    df = scored(spark, sf).select("company_name", "sector", "risk_score", "risk_tier")
    return RK.ordered_positions(df, [F.desc("risk_score"), F.asc("company_name")]).withColumnRenamed("position", "rank")


@query("peer_rank", cte("SELECT company_id, rank() OVER (PARTITION BY sector ORDER BY risk_score DESC) AS peer_rank, count(*) OVER s AS peer_count, avg(risk_score) OVER s AS peer_mean, risk_score - avg(risk_score) OVER s AS delta FROM scored WINDOW s AS (PARTITION BY sector)", "scored"), "peer_mean delta")
def peer_rank(spark, sf):
    df = scored(spark, sf).select("company_id", "sector", "risk_score")
    return R.peer_rank(df).select("company_id", "peer_rank", "peer_count", "peer_mean", "delta")


@query("ecdf_percent", cte(f"SELECT company_id, cume_dist() OVER (ORDER BY {T}) * 100 AS ecdf FROM profile", "profile"), "ecdf")
def ecdf_percent(spark, sf):
    df = A.companies(spark, sf).select("company_id", T)
    return RK.with_value_ranks(df, [], T).select("company_id", ((F.col("below") + F.col("cnt")) / F.col("n") * 100.0).alias("ecdf"))


@query("cumulative_share", """
    SELECT part, importance, row_number() OVER w AS rank, sum(importance) OVER w AS running, sum(importance) OVER w / sum(importance) OVER () * 100 AS running_pct
    FROM (SELECT l_partkey AS part, sum(l_quantity) AS importance FROM lineitem GROUP BY 1)
    WINDOW w AS (ORDER BY importance DESC, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "importance running running_pct")
def cumulative_share(spark, sf):
    imp = A.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("importance"))
    out = RK.ordered_positions(imp, [F.desc("importance"), F.asc("part")], {"imp": "importance"})
    return out.select("part", "importance", F.col("position").alias("rank"), F.col("imp_running").alias("running"),
                      (F.col("imp_running") / F.col("imp_total") * 100.0).alias("running_pct"))


def top(name, order_sql, order):
    @query(name, cte(f"SELECT company_id, company_name, risk_score FROM scored ORDER BY {order_sql} LIMIT 20", "scored"), "risk_score")
    def run(spark, sf):
        return scored(spark, sf).select("company_id", "company_name", "risk_score").orderBy(*order()).limit(20)
    return run


top("top_k", "risk_score DESC, company_name", lambda: [F.desc("risk_score"), F.asc("company_name")])
top("bottom_k", "risk_score, company_name", lambda: [F.asc("risk_score"), F.asc("company_name")])


@query("top_uncertainty", cte("SELECT id, hi - lo AS ci_width FROM (SELECT id, greatest(p1, p2, p3) AS hi, least(p1, p2, p3) AS lo FROM pred) ORDER BY ci_width DESC, id LIMIT 15", "pred"), "ci_width")
def top_uncertainty(spark, sf):
    p = A.predictions(spark, sf)
    return p.select("id", (F.greatest("p1", "p2", "p3") - F.least("p1", "p2", "p3")).alias("ci_width")).orderBy(F.desc("ci_width"), "id").limit(15)


@query("multi_sort", cte(f"SELECT company_id, sector, {T} FROM profile ORDER BY sector, {T} DESC, company_id", "profile"), T)
def multi_sort(spark, sf):
    return A.companies(spark, sf).select("company_id", "sector", T).orderBy("sector", F.desc(T), "company_id")


@query("melt", cte(unpivot_sql("profile", "company_id", [T, "controversy_score", "env_risk_score"], "metric", "value"), "profile"), "value")
def melt(spark, sf):
    return R.melt(A.companies(spark, sf), ["company_id"], [T, "controversy_score", "env_risk_score"])


SECTORS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("pivot", cte(f"""
    SELECT metric, {", ".join(f"max(value) FILTER (WHERE sector = '{s}') AS {s.lower()}" for s in SECTORS)}
    FROM ({unpivot_sql('profile', 'sector', [T, 'controversy_score', 'env_risk_score'], 'metric', 'value')}) GROUP BY metric""", "profile"), " ".join(SECTORS).lower())
def pivot(spark, sf):
    """One column per sector; a sector outside the list would be lost, so it raises."""
    long = R.melt(A.companies(spark, sf), ["sector"], [T, "controversy_score", "env_risk_score"])
    stray = F.raise_error(F.concat(F.lit("unknown sector "), F.coalesce("sector", F.lit("null"))))
    long = long.withColumn("sector", F.when(F.col("sector").isin(SECTORS), F.col("sector")).otherwise(stray.cast("string")))
    return long.groupBy("metric").pivot("sector", SECTORS).agg(F.max("value")).withColumnsRenamed({s: s.lower() for s in SECTORS})


CMP = ["risk_score", T, "controversy_score", "gw_proxy_score", *PILLARS, "pillar_imbalance_score", "controversy_risk_ratio", "esg_controversy_divergence",
       "greenwashing_signal_score", "vague_language_count", "concrete_evidence_count", "text_polarity", "combined_anomaly_score"]
#: metrics that the text packs add, and those whose value is a text
CMP_TEXTS = ["flesch_reading_ease", "aggregate_esg_nlp_score", "regulatory_readiness_score", "policy_esg_gap", "narrative_credibility_index",
             "commitment_credibility_score", "multi_signal_greenwashing_score", "temporal_greenwashing_signal", "news_greenwashing_signal"]
CMP_LABELS = ["risk_tier"]
SLOTS = (1, 2, 3)
CTES["compared"] = (("scored", "nlp"), f"SELECT scored.*, {', '.join('nlp.' + c for c in CMP_TEXTS)} FROM scored JOIN nlp USING (company_id)")
PICK = "SELECT company_id, sector, CAST(row_number() OVER (ORDER BY risk_score DESC, company_name) AS INTEGER) AS slot FROM scored ORDER BY slot LIMIT 3"


@query("comparison_table", cte(f"""
    , l AS ({unpivot_sql('compared', 'company_id, company_name, sector, risk_score AS s', CMP + CMP_TEXTS, 'metric', 'value')}), pick AS ({PICK}),
    t AS (SELECT company_id, 'risk_tier' AS metric, CAST(risk_tier AS VARCHAR) AS label FROM compared)
    SELECT metric, {', '.join(f"max(value) FILTER (WHERE slot = {i}) AS company_{i}" for i in SLOTS)},
           avg(value) FILTER (WHERE l.sector = (SELECT sector FROM pick WHERE slot = 1)) AS sector_avg, {', '.join(f"NULL::VARCHAR AS label_{i}" for i in SLOTS)}
    FROM l LEFT JOIN pick USING (company_id) GROUP BY metric
    UNION ALL SELECT metric, {', '.join('NULL::DOUBLE' for _ in SLOTS)}, NULL::DOUBLE, {', '.join(f"max(label) FILTER (WHERE slot = {i})" for i in SLOTS)} FROM t JOIN pick USING (company_id) GROUP BY metric""", "compared"),
       "company_1 company_2 company_3 sector_avg")
def comparison_table(spark, sf):
    """All metrics of the three riskiest companies side by side, numbers and labels, with the first one's sector average."""
    texts = N.all_nlp(A.profile(spark, sf).select("company_id", "description")).select("company_id", *CMP_TEXTS)
    df = materialize(scored(spark, sf).select("company_id", "company_name", "sector", *CMP, *CMP_LABELS).join(texts, "company_id"))
    return R.comparison(df, riskiest(df), CMP + CMP_TEXTS, CMP_LABELS, SLOTS)


def riskiest(df):
    """The companies to compare, as a table with the place of each."""
    from pyspark.sql import Window
    order = [F.desc("risk_score"), "company_name"]
    top = df.orderBy(*order).limit(len(SLOTS))
    return top.select("company_id", F.row_number().over(Window.orderBy(*order)).alias("slot"))  # three rows


@query("status_pivot", cte(f"""
    , pick AS ({PICK}), i AS ({unpivot_sql('scored', 'company_id', ['controversy_risk_ratio', 'esg_controversy_divergence', 'greenwashing_signal_score'], 'indicator', 'value')}),
    q AS (SELECT indicator, quantile_cont(value, 0.75) AS threshold FROM i GROUP BY indicator)
    SELECT indicator, {', '.join(f"max(CASE WHEN value > threshold THEN 'HIGH' ELSE 'Normal' END) FILTER (WHERE slot = {i}) AS company_{i}" for i in SLOTS)}
    FROM i JOIN q USING (indicator) JOIN pick USING (company_id) GROUP BY indicator""", "scored"))
def status_pivot(spark, sf):
    """A pivot of texts: which indicators of the compared companies are high."""
    indicators = ["controversy_risk_ratio", "esg_controversy_divergence", "greenwashing_signal_score"]
    df = scored(spark, sf).select("company_id", "company_name", "risk_score", *indicators)
    limits = RK.column_quantiles(df, indicators, {"p75": 0.75})
    table = U.indicator_table(df, {c: limits[f"{c}_p75"] for c in indicators}, indicators)
    named = RK.attach_group(table, riskiest(df), ["company_id"]).filter("slot IS NOT NULL")
    wide = named.groupBy("indicator").pivot("slot", list(SLOTS)).agg(F.max("status"))
    return wide.withColumnsRenamed({str(i): f"company_{i}" for i in SLOTS})


@query("batch_entity_export", cte("SELECT company_id, sector, risk_score, quality FROM scored LEFT JOIN labels ON doc_id = company_id WHERE controversy_score >= 4", "scored"), "risk_score")
def batch_entity_export(spark, sf):
    """One row per listed entity from three tables, written by sector and read back."""
    df = scored(spark, sf)
    wanted = A.profile(spark, sf).filter(F.col("controversy_score") >= 4).select("company_id")
    labels = A.table(spark, sf, "labels").select(F.col("doc_id").alias("company_id"), "quality")
    out = df.select("company_id", "sector", "risk_score").join(wanted, "company_id", "left_semi").join(labels, "company_id", "left")
    path = scratch(spark)
    RD.write_csv(out, path, ["sector"])
    return spark.read.csv(path, header=True, schema="company_id long, risk_score double, quality int, sector string")


# ------------------------------------------------------------------ rules
TEXT_COLS = ["regulatory_readiness_score", "policy_esg_gap", "narrative_credibility_index", "promotional_dominance_score",
             "commitment_credibility_score", "temporal_greenwashing_signal", "aggregate_esg_nlp_score"]
CTES["allrows"] = (("scored", "nlp"), f"SELECT scored.*, {', '.join('nlp.' + c for c in TEXT_COLS)} FROM scored JOIN nlp USING (company_id)")


def full_rows(spark, sf):
    texts = N.all_nlp(A.profile(spark, sf).select("company_id", "description")).select("company_id", *TEXT_COLS)
    return materialize(scored(spark, sf).join(texts, "company_id"))


def over(c, p):
    return f"(SELECT quantile_cont({c}, {p}) FROM fullrows)"


RULES = [
    ("divergence", f"CASE WHEN esg_controversy_divergence > {over('esg_controversy_divergence', 0.75)} THEN 'critical' WHEN esg_controversy_divergence > {over('esg_controversy_divergence', 0.5)} THEN 'warning' ELSE 'good' END"),
    ("controversy_ratio", f"CASE WHEN controversy_risk_ratio > {over('controversy_risk_ratio', 0.75)} THEN 'critical' WHEN controversy_risk_ratio > {over('controversy_risk_ratio', 0.5)} THEN 'warning' END"),
    ("wording", f"CASE WHEN greenwashing_signal_score > {over('greenwashing_signal_score', 0.75)} THEN 'critical' WHEN vague_language_count > concrete_evidence_count AND vague_language_count > 2 THEN 'warning' WHEN concrete_evidence_count > vague_language_count AND concrete_evidence_count > 1 THEN 'good' END"),
    ("imbalance", "CASE WHEN pillar_imbalance_score > 1.5 * (SELECT avg(pillar_imbalance_score) FROM fullrows) THEN 'warning' ELSE 'good' END"),
    ("mismatch", "CASE WHEN risk_controversy_mismatch = 1 THEN 'critical' END"),
    ("anomaly", f"CASE WHEN combined_anomaly_score > {over('combined_anomaly_score', 0.75)} THEN 'warning' END"),
    ("positive_tone", f"CASE WHEN text_polarity > {over('text_polarity', 0.85)} THEN 'warning' END"),
    ("readiness", "CASE WHEN regulatory_readiness_score < 0.15 AND policy_esg_gap > 0.6 THEN 'critical' WHEN regulatory_readiness_score > 0.4 THEN 'good' END"),
    ("narrative", "CASE WHEN promotional_dominance_score > 0.6 AND narrative_credibility_index < 0.3 THEN 'warning' WHEN narrative_credibility_index > 0.6 THEN 'good' END"),
    ("commitment", "CASE WHEN commitment_credibility_score < 0.3 AND temporal_greenwashing_signal > 0.7 THEN 'warning' WHEN commitment_credibility_score > 0.7 THEN 'good' END"),
    ("text_score", "CASE WHEN aggregate_esg_nlp_score < 30 THEN 'critical' WHEN aggregate_esg_nlp_score > 70 THEN 'good' END"),
    ("peers", "CASE WHEN rk <= 3 AND pn >= 5 THEN 'critical' WHEN risk_score > pm + 10 THEN 'warning' WHEN risk_score < pm - 10 THEN 'good' END"),
    ("proxy", "CASE WHEN gw_proxy_score >= 3 THEN 'critical' WHEN gw_proxy_score = 2 THEN 'warning' END"),
]
CTES["fullrows"] = (("allrows",), "SELECT *, rank() OVER (PARTITION BY sector ORDER BY risk_score DESC) AS rk, count(*) OVER (PARTITION BY sector) AS pn, avg(risk_score) OVER (PARTITION BY sector) AS pm FROM allrows")


SQL_NAMES = {"peer_rank": "rk", "peer_mean": "pm"}


def shown_sql(name, part):
    return "CASE severity " + " ".join(f"WHEN '{s}' THEN {part(d)}" for s, d in U.DETAILS[name].items()) + " END"


def limit_sql(spec):
    if isinstance(spec, tuple):
        return f"CAST({SQL_NAMES.get(spec[0], spec[0])} + {spec[1]} AS DOUBLE)"
    if isinstance(spec, str):
        if spec.startswith("mean_imbalance"):
            return f"{spec.partition('*')[2]} * (SELECT avg(pillar_imbalance_score) FROM fullrows)"
        column, _, p = spec.partition("|p")
        return over(column, int(p) / 100)
    return f"{float(spec)}::DOUBLE"


@query("reason_engine", cte("SELECT company_id, rule_no, rule, severity, detail, value, threshold FROM (" + " UNION ALL ".join(
    f"""SELECT company_id, {i} AS rule_no, '{n}' AS rule, severity, {shown_sql(n, lambda d: text(d[2]))} AS detail,
        {shown_sql(n, lambda d: f"CAST({SQL_NAMES.get(d[0], d[0])} AS DOUBLE)")} AS value, {shown_sql(n, lambda d: limit_sql(d[1]))} AS threshold
        FROM (SELECT *, {sql} AS severity FROM fullrows)""" for i, (n, sql) in enumerate(RULES)) + ") WHERE severity IS NOT NULL", "fullrows"), "value threshold")
def reason_engine(spark, sf):
    df = full_rows(spark, sf)
    return U.reasons(R.peer_rank(df), U.population_limits(df))


INDS = ["controversy_risk_ratio", "esg_controversy_divergence", "greenwashing_signal_score", "pillar_imbalance_score", "combined_anomaly_score"]


@query("indicator_table", cte(f"""
    SELECT company_id, indicator, value, threshold, CASE WHEN value > threshold THEN 'HIGH' ELSE 'Normal' END AS status
    FROM ({unpivot_sql('inputs', 'company_id', INDS, 'indicator', 'value')}) JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS indicator, quantile_cont({c}, 0.75) AS threshold FROM inputs" for c in INDS)}) USING (indicator)""", "inputs"), "value threshold")
def indicator_table(spark, sf):
    df = score_inputs(spark, sf)
    limits = RK.column_quantiles(df, INDS, {"p75": 0.75})
    return U.indicator_table(df, {c: limits[f"{c}_p75"] for c in INDS}, INDS)


FIXED = {"controversy_risk_ratio": 0.15, "esg_controversy_divergence": 0.5, "greenwashing_signal_score": 0.45, "pillar_imbalance_score": 3.5, "combined_anomaly_score": 1.5}


@query("indicator_table_fixed", cte(f"""
    SELECT company_id, indicator, value, threshold, CASE WHEN value > threshold THEN 'HIGH' ELSE 'Normal' END AS status
    FROM ({unpivot_sql('inputs', 'company_id', INDS, 'indicator', 'value')}) JOIN (VALUES {', '.join(f"('{c}', {v}::DOUBLE)" for c, v in FIXED.items())}) AS d(indicator, threshold) USING (indicator)""", "inputs"), "value threshold")
def indicator_table_fixed(spark, sf):
    return U.indicator_table(score_inputs(spark, sf), FIXED, INDS)


@query("verdict_band", cte("SELECT company_id, CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM scored", "scored"))
def verdict_band(spark, sf):
    return scored(spark, sf).select("company_id", L.verdict(F.col("risk_score")).alias("verdict"))


AXES = [T, "controversy_score", "env_risk_score", "social_risk_score", "gov_risk_score"]


def axis_sql(c):
    def s(v):
        return f"({v} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8)"
    return f"SELECT company_id, '{c}' AS axis, {s(c)} AS value, {s(f'avg({c}) OVER ()')} AS population, {s(f'avg({c}) OVER (PARTITION BY sector)')} AS sector_mean FROM clean"


@query("profile_vs_population", cte(" UNION ALL ".join(axis_sql(c) for c in AXES), "clean"), "value population sector_mean")
def profile_vs_population(spark, sf):
    return U.profile_vs_population(materialize(clean_companies(spark, sf)), AXES)


@query("report_vs_model_gap", cte("""
    SELECT company_id, report_score, risk_score AS model_score, report_score - risk_score AS gap,
           CASE WHEN report_score - risk_score > 20 THEN 'REPORT_HIGHER' WHEN report_score - risk_score < -20 THEN 'MODEL_HIGHER' ELSE 'CONSISTENT' END AS flag
    FROM scored JOIN (SELECT company_id, CAST(controversy_score * 15 AS DOUBLE) AS report_score FROM profile) USING (company_id)""", "scored", "profile"), "report_score model_score gap")
def report_vs_model_gap(spark, sf):
    df = scored(spark, sf).select("company_id", (F.col("controversy_score") * 15.0).alias("report_score"), F.col("risk_score").alias("model_score"))
    return U.report_gap(df)


FVP = ["text_polarity", "greenwashing_signal_score", "vague_language_density"]


@query("feature_vs_population", cte(f"""
    SELECT company_id, feature, value, avg(value) OVER f AS population_mean, value - avg(value) OVER f AS difference,
           (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0) / count(*) OVER f * 100 AS percentile
    FROM ({unpivot_sql('nlp2', 'company_id', FVP, 'feature', 'value')}) WINDOW f AS (PARTITION BY feature)""", "nlp2"), "value population_mean difference percentile")
def feature_vs_population(spark, sf):
    text = N.linguistic_pack(N.polarity_pack(N.prepare(A.profile(spark, sf).select("company_id", "description"))))
    return U.feature_vs_population(materialize(text.select("company_id", *FVP)), FVP)


@query("uncertainty_band", cte("""
    SELECT id, std, CASE WHEN std < 0.05 THEN 'stable' WHEN std < 0.15 THEN 'moderate' ELSE 'manual review' END AS band
    FROM (SELECT id, stddev_pop(p) AS std FROM pred_long GROUP BY id)""", "pred_long"), "std")
def uncertainty_band(spark, sf):
    p = A.predictions_long(spark, sf).groupBy("id").agg(F.stddev_pop("p").alias("std"))
    return p.withColumn("band", U.uncertainty_band(F.col("std")))


# ------------------------------------------------------------------ the whole pipeline
@query("risk_pipeline", cte("""
    , r AS (SELECT *, CAST(round_even(0.4 * comp_proxy + 0.15 * comp_linguistic + 0.15 * comp_divergence + 0.15 * (1 - coalesce(claim_credibility_score, 0)) * 100
                      + 0.15 * comp_controversy_ratio, 2) AS DOUBLE) AS score
            FROM comps LEFT JOIN (SELECT doc_id AS company_id, claim_credibility_score FROM claim_metrics) USING (company_id))
    SELECT company_id, sector, score AS risk_score, CASE WHEN score <= 20 THEN 'Very Low Risk' WHEN score <= 40 THEN 'Low Risk' WHEN score <= 60 THEN 'Moderate Risk'
           WHEN score <= 80 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_tier FROM r""", "comps", "claim_metrics"), "risk_score")
def risk_pipeline(spark, sf):
    """Labels, components, score and tier with claim credibility joined in."""
    from discloscope.operators import documents as D
    docs = A.corpus(spark, sf).withColumnRenamed("doc_id", "company_id")
    metrics = D.claim_metrics(docs.select("company_id"), D.extract_claims(docs, "company_id", "description"), "company_id")
    df = score_inputs(spark, sf).join(metrics.select("company_id", "claim_credibility_score"), "company_id", "left") \
        .na.fill(0.0, ["claim_credibility_score"])
    staged = materialize(df)
    known = L.score_figures(staged)
    out = L.final_score(L.component_scores(L.proxy_labels(staged, known), known))
    return out.select("company_id", "sector", "risk_score", "risk_tier")
