"""Categorical feature packs: frequencies, bins, segments, issue flags, group profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions.exprs import clip, total, with_globals
from discloscope.functions.ranking import attach_group, value_ranks
from discloscope.operators.cleaning import pillar_bin, total_bin


def frequency_encode(df: DataFrame, columns: Sequence[str] = ("sector", "industry"), base: DataFrame | None = None) -> DataFrame:
    """Category count and share of all rows; a NULL category gives NULL."""
    base = df if base is None else base
    out = with_globals(df, base.agg(F.count(F.lit(1)).alias("n")), "_all")
    for c in columns:
        counts = base.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(f"{c}_frequency"))
        out = attach_group(out, counts, [c]).withColumn(f"{c}_proportion", F.col(f"{c}_frequency") / F.col("_all.n"))
    return out.drop("_all")


def risk_bins(df: DataFrame) -> DataFrame:
    bins = {f"{p}_risk_bin": pillar_bin(F.col(f"{p}_risk_score")) for p in ("env", "social", "gov")}
    out = df.withColumns({"esg_risk_bin": total_bin(F.col("total_esg_risk_score")),
                          "controversy_bin": clip(F.col("controversy_score") - 1, 0, 4), **bins})
    return out.withColumns({
        "cross_risk_bin": total([F.col(c) for c in bins]), "high_risk_flag": (F.col("esg_risk_bin") >= 3).cast("int"),
        "high_controversy_flag": F.coalesce((F.col("controversy_score") >= 4).cast("int"), F.lit(0))})


def first_seen_codes(df: DataFrame, column: str, ordinal: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """Codes 0, 1, ... by first appearance in ingest order; NULL gives -1.

    First appearances are ranked in value ranges, so neither rows nor distinct values meet in one task.
    """
    firsts = (df if base is None else base).filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(ordinal).alias("_first"))
    ranks = value_ranks(firsts, [], "_first").select("_first", F.col("below").cast("int").alias(out))
    codes = firsts.join(ranks, "_first").select(column, out)
    return attach_group(df, codes, [column]).withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def mismatch_flag():
    return F.coalesce(((F.col("esg_risk_bin") <= 1) & (F.col("controversy_bin") >= 3)).cast("int"), F.lit(0))


def _cross_columns(df: DataFrame) -> DataFrame:
    r, c = F.col("esg_risk_bin"), F.col("controversy_bin")
    return df.withColumns({
        "esg_controversy_segment": F.concat_ws("_", r.cast("int").cast("string"), c.cast("int").cast("string")),
        "risk_controversy_mismatch": mismatch_flag(), "risk_controversy_gap": c,
        "sector_risk_segment": F.concat("sector", F.lit("_"), r.cast("int").cast("string")),
        "esg_performance_tier": F.when((r <= 1) & (c <= 1), 3).when((r <= 2) & (c <= 2), 2).when((r <= 3) | (c <= 3), 1).otherwise(0)})


def cross_features(df: DataFrame, ordinal: str = "company_id", base: DataFrame | None = None) -> DataFrame:
    """Needs ``risk_bins`` on the rows; ``base`` may be the rows before it."""
    out = _cross_columns(df)
    plain = out if base is None else _cross_columns(risk_bins(base))
    for seg in ("esg_controversy_segment", "sector_risk_segment"):
        out = first_seen_codes(out, seg, ordinal, f"{seg}_encoded", plain)
    return out


def issue_flags(df: DataFrame, columns: Sequence[str] = ("material_issue_1", "material_issue_2", "material_issue_3")) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    if not present:
        names = ["has_material_issues", "material_issue_count", *V.ISSUE_FAMILIES]
        return df.withColumns({n: F.lit(0) for n in names})
    count = total([F.col(c).isNotNull().cast("int") for c in present])
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in present]))
    return df.withColumns({
        "has_material_issues": (count > 0).cast("int"), "material_issue_count": count,
        **{name: joined.rlike(rx).cast("int") for name, rx in V.ISSUE_FAMILIES.items()}})


def group_profile(df: DataFrame, group: str = "sector") -> DataFrame:
    t = "total_esg_risk_score"
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(t).alias("sector_avg_esg"), F.avg("controversy_score").alias("sector_avg_controversy"),
        F.max(t).alias("sector_max_esg"), F.min(t).alias("sector_min_esg"), F.count(t).alias("sector_company_count"),
        (F.max(t) - F.min(t)).alias("sector_esg_spread"), F.avg("high_risk_flag").alias("sector_high_risk_ratio"))


def all_categorical(df: DataFrame, ordinal: str = "company_id", base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    out = issue_flags(cross_features(risk_bins(frequency_encode(df, base=base)), ordinal, base))
    return attach_group(out, group_profile(risk_bins(base)), ["sector"])


FEATURES = {
    "frequency": ["sector_frequency", "sector_proportion", "industry_frequency", "industry_proportion"],
    "risk_bins": ["esg_risk_bin", "controversy_bin", "env_risk_bin", "social_risk_bin", "gov_risk_bin", "cross_risk_bin",
                  "high_risk_flag", "high_controversy_flag"],
    "cross": ["esg_controversy_segment_encoded", "risk_controversy_mismatch", "risk_controversy_gap",
              "sector_risk_segment_encoded", "esg_performance_tier"],
    "issues": ["has_material_issues", "material_issue_count", *V.ISSUE_FAMILIES],
    "sector_profile": ["sector_avg_esg", "sector_avg_controversy", "sector_max_esg", "sector_min_esg", "sector_esg_spread",
                       "sector_company_count", "sector_high_risk_ratio"],
}
ALL_FEATURES = [f for fs in FEATURES.values() for f in fs]
