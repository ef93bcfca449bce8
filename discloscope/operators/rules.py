"""Reasons, indicator tables, verdict and uncertainty bands. Population figures arrive as literals or scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.functions.exprs import with_globals
from discloscope.functions.ranking import attach_group, average_percentile, column_quantiles, value_ranks, _join_keys
from discloscope.operators.relational import melt

QUANTILES = {"esg_controversy_divergence": (0.75, 0.5), "controversy_risk_ratio": (0.75, 0.5), "greenwashing_signal_score": (0.75, 0.75),
             "combined_anomaly_score": (0.75, 0.75), "text_polarity": (0.85, 0.85)}


# fixed values: per rule and severity the column that is named, what it is held against, and the text. A limit is a number,
# a population quantile "column|p75", a multiple of a mean "mean_imbalance*1.5", or another column, moved by a number.
DETAILS: dict[str, dict[str, tuple[str, object, str]]] = {
    "divergence": {"critical": ("esg_controversy_divergence", "esg_controversy_divergence|p75", "Controversy is far above what the stated risk suggests"),
                   "warning": ("esg_controversy_divergence", "esg_controversy_divergence|p50", "Stated risk and controversy differ somewhat"),
                   "good": ("esg_controversy_divergence", "esg_controversy_divergence|p50", "Stated risk and controversy agree")},
    "controversy_ratio": {"critical": ("controversy_risk_ratio", "controversy_risk_ratio|p75", "Controversy is high for this risk score"),
                          "warning": ("controversy_risk_ratio", "controversy_risk_ratio|p50", "Controversy is raised for this risk score")},
    "wording": {"critical": ("greenwashing_signal_score", "greenwashing_signal_score|p75", "The wording promises more than it shows"),
                "warning": ("vague_language_count", ("concrete_evidence_count", 0.0), "Vague terms outnumber concrete ones"),
                "good": ("concrete_evidence_count", ("vague_language_count", 0.0), "Concrete terms outnumber vague ones")},
    "imbalance": {"warning": ("pillar_imbalance_score", "mean_imbalance*1.5", "Pillar scores lie far apart"),
                  "good": ("pillar_imbalance_score", "mean_imbalance*1.5", "Pillar scores are balanced")},
    "mismatch": {"critical": ("risk_controversy_mismatch", 0.0, "A low risk score goes with high controversy")},
    "anomaly": {"warning": ("combined_anomaly_score", "combined_anomaly_score|p75", "The scores are an unusual combination")},
    "positive_tone": {"warning": ("text_polarity", "text_polarity|p85", "The tone is unusually positive")},
    "readiness": {"critical": ("regulatory_readiness_score", 0.15, "Policy is spoken of without readiness"), "good": ("regulatory_readiness_score", 0.4, "Texts show readiness for regulation")},
    "narrative": {"warning": ("promotional_dominance_score", 0.6, "Promotion without a credible account"), "good": ("narrative_credibility_index", 0.6, "The account is credible")},
    "commitment": {"warning": ("temporal_greenwashing_signal", 0.7, "Commitments are distant and thin"), "good": ("commitment_credibility_score", 0.7, "Commitments are credible")},
    "text_score": {"critical": ("aggregate_esg_nlp_score", 30.0, "Texts score low"), "good": ("aggregate_esg_nlp_score", 70.0, "Texts score high")},
    "peers": {"critical": ("peer_rank", 3.0, "Among the riskiest of its sector"), "warning": ("risk_score", ("peer_mean", 10.0), "Riskier than its sector"),
              "good": ("risk_score", ("peer_mean", -10.0), "Less risky than its sector")},
    "proxy": {"critical": ("gw_proxy_score", 3.0, "Three indicators or more are raised"), "warning": ("gw_proxy_score", 2.0, "Two indicators are raised")},
}


def population_limits(df: DataFrame) -> dict[str, float | None]:
    out = column_quantiles(df, list(QUANTILES), {"p50": 0.5, "p75": 0.75, "p85": 0.85})
    out["mean_imbalance"] = df.agg(F.avg("pillar_imbalance_score")).first()[0]
    return out


def reasons(df: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """One row per triggered rule: (rule_no, rule, severity, detail, value, threshold). Needs peer columns and the text packs."""
    def q(col: str, p: str) -> Column:
        return F.lit(limits[f"{col}_{p}"])

    def c(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default))

    div, ratio, sig = c("esg_controversy_divergence"), c("controversy_risk_ratio"), c("greenwashing_signal_score")
    vague, concrete = c("vague_language_count"), c("concrete_evidence_count")
    ready, gap = c("regulatory_readiness_score"), c("policy_esg_gap", 0.5)
    narrative, promo = c("narrative_credibility_index", 0.5), c("promotional_dominance_score")
    commit, temporal = c("commitment_credibility_score", 0.5), c("temporal_greenwashing_signal", 0.5)
    agg, proxy, score = c("aggregate_esg_nlp_score", 50.0), c("gw_proxy_score"), c("risk_score")
    rules = [
        ("divergence", F.when(div > q("esg_controversy_divergence", "p75"), "critical")
         .when(div > q("esg_controversy_divergence", "p50"), "warning").otherwise("good")),
        ("controversy_ratio", F.when(ratio > q("controversy_risk_ratio", "p75"), "critical").when(ratio > q("controversy_risk_ratio", "p50"), "warning")),
        ("wording", F.when(sig > q("greenwashing_signal_score", "p75"), "critical").when((vague > concrete) & (vague > 2), "warning")
         .when((concrete > vague) & (concrete > 1), "good")),
        ("imbalance", F.when(c("pillar_imbalance_score") > F.lit(limits["mean_imbalance"]) * 1.5, "warning").otherwise("good")),
        ("mismatch", F.when(c("risk_controversy_mismatch") > 0, "critical")),
        ("anomaly", F.when(c("combined_anomaly_score") > q("combined_anomaly_score", "p75"), "warning")),
        ("positive_tone", F.when(c("text_polarity") > q("text_polarity", "p85"), "warning")),
        ("readiness", F.when((ready < 0.15) & (gap > 0.6), "critical").when(ready > 0.4, "good")),
        ("narrative", F.when((promo > 0.6) & (narrative < 0.3), "warning").when(narrative > 0.6, "good")),
        ("commitment", F.when((commit < 0.3) & (temporal > 0.7), "warning").when(commit > 0.7, "good")),
        ("text_score", F.when(agg < 30, "critical").when(agg > 70, "good")),
        ("peers", F.when(F.col("sector").isNotNull(), F.when((F.col("peer_rank") <= 3) & (F.col("peer_count") >= 5), "critical")
                         .when(score > F.col("peer_mean") + 10, "warning").when(score < F.col("peer_mean") - 10, "good"))),
        ("proxy", F.when(proxy >= 3, "critical").when(proxy == 2, "warning")),
    ]

    def limit(spec) -> Column:
        if isinstance(spec, tuple):
            return F.col(spec[0]).cast("double") + spec[1]
        if isinstance(spec, str):
            name, _, factor = spec.partition("*")
            return F.lit(limits[name.replace("|", "_")]) * float(factor or 1)
        return F.lit(float(spec))

    def shown(name: str, sev: Column, part) -> Column:
        return F.coalesce(*[F.when(sev == s, part(d)) for s, d in DETAILS[name].items()])

    fired = F.array_compact(F.array(*[
        F.when(sev.isNotNull(), F.struct(
            F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), sev.alias("severity"), shown(name, sev, lambda d: F.lit(d[2])).alias("detail"),
            shown(name, sev, lambda d: F.col(d[0]).cast("double")).alias("value"), shown(name, sev, lambda d: limit(d[1])).alias("threshold")))
        for i, (name, sev) in enumerate(rules)]))
    return df.select("company_id", F.explode(fired).alias("r")).select("company_id", "r.*")


def indicator_table(df: DataFrame, limits: dict[str, float | None], indicators: Sequence[str]) -> DataFrame:
    """Entity x indicator: value, threshold, HIGH or Normal."""
    long = melt(df, ["company_id"], indicators, "indicator")
    at = F.coalesce(*[F.when(F.col("indicator") == c, F.lit(limits[c])) for c in indicators])
    return long.withColumn("threshold", at).withColumn(
        "status", F.when(F.col("value") > F.col("threshold"), "HIGH").otherwise("Normal"))


def profile_vs_population(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each axis min-max scaled over the population, with the population and sector means on the same scale."""
    ends = df.agg(*[x for c in axes for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.avg(c).alias(f"{c}_mean"))])
    sector = df.groupBy("sector").agg(*[F.avg(c).alias(f"_sec_{c}") for c in axes])
    wide = with_globals(attach_group(df, sector, ["sector"]), ends, "_e")

    def scaled(c: str, v: Column) -> Column:
        return (v - F.col(f"_e.{c}_lo")) / (F.col(f"_e.{c}_hi") - F.col(f"_e.{c}_lo") + 1e-8)

    return wide.select("company_id", F.explode(F.array(*[F.struct(
        F.lit(c).alias("axis"), scaled(c, F.col(c).cast("double")).alias("value"), scaled(c, F.col(f"_e.{c}_mean")).alias("population"),
        scaled(c, F.col(f"_sec_{c}")).alias("sector_mean")) for c in axes])).alias("s")).select("company_id", "s.*")


def feature_vs_population(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Entity x feature: value, population mean, difference and average-tie percentile."""
    long = melt(df, ["company_id"], features, "feature")
    means = with_globals(long, df.agg(*[F.avg(c).alias(c) for c in features]), "_m")
    mean = F.coalesce(*[F.when(F.col("feature") == c, F.col(f"_m.{c}")) for c in features])
    ranks = value_ranks(long, ["feature"], "value")
    out = _join_keys(means.withColumn("population_mean", mean).drop("_m"), ranks, ["feature", "value"], "left")
    return out.withColumns({"difference": F.col("value") - F.col("population_mean"), "percentile": average_percentile() * 100.0}) \
        .drop("cnt", "below", "n")


def report_gap(df: DataFrame) -> DataFrame:
    gap = F.col("report_score") - F.col("model_score")
    return df.withColumn("gap", gap).withColumn("flag", F.when(gap > 20, "REPORT_HIGHER").when(gap < -20, "MODEL_HIGHER").otherwise("CONSISTENT"))


def uncertainty_band(std: Column) -> Column:
    return F.when(std < 0.05, "stable").when(std < 0.15, "moderate").otherwise("manual review")
