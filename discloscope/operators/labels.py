"""Proxy labels, component scores, final score and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions.exprs import clip, cut, total, with_globals
from discloscope.functions.ranking import figures

QUANTILE_INDICATORS = {
    "gw_indicator_1": "esg_controversy_divergence", "gw_indicator_2": "greenwashing_signal_score",
    "gw_indicator_4": "controversy_risk_ratio", "gw_indicator_5": "combined_anomaly_score"}
RANGED = ("esg_controversy_divergence", "controversy_risk_ratio")
MISMATCH_INDICATOR = ("gw_indicator_3", "risk_controversy_mismatch")
WEIGHTS = {"comp_proxy": 0.40, "comp_linguistic": 0.15, "comp_divergence": 0.15, "comp_credibility_inv": 0.15,
           "comp_controversy_ratio": 0.15}


def score_figures(df: DataFrame, rows: int | None = None) -> dict[str, float | None]:
    """Population 75th percentiles of the four graded indicators and ends of the min-max inputs, in one round."""
    graded = [c for c in QUANTILE_INDICATORS.values() if c in df.columns]
    ends = {n: a for c in RANGED if c in df.columns for n, a in ((f"{c}_lo", F.min(c)), (f"{c}_hi", F.max(c)))}
    return figures(df, {c: {"p75": 0.75} for c in graded}, ends, rows)


def thresholds(df: DataFrame) -> dict[str, float | None]:
    """Population 75th percentiles of the four graded indicators."""
    return {k: v for k, v in score_figures(df).items() if k.endswith("_p75")}


def proxy_labels(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Five indicators, their sum, a binary label at 2 and a three-way class. A missing input gives indicator 0."""
    limits = thresholds(df) if limits is None else limits
    flags = {}
    for flag, col in QUANTILE_INDICATORS.items():
        known = col in df.columns
        flags[flag] = F.coalesce((F.col(col) > F.col(f"_lim.{col}_p75")).cast("int"), F.lit(0)) if known else F.lit(0)
    flag, col = MISMATCH_INDICATOR
    flags[flag] = F.coalesce(F.col(col).cast("int"), F.lit(0)) if col in df.columns else F.lit(0)
    out = with_globals(df, limits, "_lim").withColumns(flags).drop("_lim")
    out = out.withColumn("gw_proxy_score", total([F.col(f"gw_indicator_{i}") for i in range(1, 6)]))
    score = F.col("gw_proxy_score")
    return out.withColumns({"gw_label_binary": (score >= 2).cast("int"), "gw_label_multiclass": cut(score, [-1, 1, 3, 5], [0, 1, 2])})


def component_scores(df: DataFrame, ends: dict | None = None) -> DataFrame:
    """Each component on 0-100; 50 where its input column is absent, 0 where a min-max input is constant.

    ``ends``: the figures of ``score_figures`` where they are known already.
    """
    ranged = [c for c in RANGED if c in df.columns]
    out = df if ends is None else with_globals(df, ends, "_ends")
    if ranged and ends is None:
        ends = df.agg(*[a.alias(n) for c in ranged for a, n in ((F.min(c), f"{c}_lo"), (F.max(c), f"{c}_hi"))])
        out = with_globals(df, ends, "_ends")

    def direct(col, expr):
        return clip(expr, 0, 100) if col in df.columns else F.lit(50.0)

    def minmax(col):
        if col not in df.columns:
            return F.lit(50.0)
        lo, hi = F.col(f"_ends.{col}_lo"), F.col(f"_ends.{col}_hi")
        return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(col) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100.0)

    return out.withColumns({
        "comp_proxy": direct("gw_proxy_score", F.col("gw_proxy_score") / 5.0 * 100.0),
        "comp_linguistic": direct("greenwashing_signal_score", F.col("greenwashing_signal_score") * 100.0),
        "comp_divergence": minmax("esg_controversy_divergence"),
        "comp_credibility_inv": direct("claim_credibility_score", (1.0 - F.col("claim_credibility_score")) * 100.0),
        "comp_controversy_ratio": minmax("controversy_risk_ratio")}).drop("_ends")


def risk_tier(score):
    return cut(score, V.TIER_EDGES, V.TIERS, include_lowest=True)


def final_score(df: DataFrame) -> DataFrame:
    blend = total([F.col(c) * w for c, w in WEIGHTS.items()])
    return df.withColumn("risk_score", clip(F.bround(blend, 2), 0, 100)).withColumn("risk_tier", risk_tier(F.col("risk_score")))


def verdict(score):
    return F.when(score >= 60, "HIGH").when(score >= 40, "MODERATE").otherwise("LOW")


def scenario_score(df: DataFrame, limits: dict) -> DataFrame:
    """Share of the five indicators a (possibly modified) row triggers against given population limits, times 100."""
    hits = [F.coalesce((F.col(c) > F.col(f"_lim.{c}_p75")).cast("int"), F.lit(0)) for c in QUANTILE_INDICATORS.values()]
    hits.append(F.coalesce((F.col("risk_controversy_mismatch") > 0).cast("int"), F.lit(0)))
    return with_globals(df, limits, "_lim").withColumn("scenario_score", total(hits) / 5.0 * 100.0).drop("_lim")
