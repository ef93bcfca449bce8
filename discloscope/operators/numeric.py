"""Numeric feature packs on the profile table. Global figures arrive as scalar subqueries, never as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.functions.exprs import EPS, eps_ratio, row_mean, row_std, row_var, total, with_globals
from discloscope.functions.ranking import attach_group, average_percentile, column_quantiles, figures, with_value_ranks
from discloscope.session import materialize

PILLARS = ["env_risk_score", "social_risk_score", "gov_risk_score"]
TOTAL, CONTROVERSY = "total_esg_risk_score", "controversy_score"


def _pillars() -> list[Column]:
    return [F.col(c) for c in PILLARS]


def pillar_ratios(df: DataFrame) -> DataFrame:
    t, e, s, g = F.col(TOTAL), *_pillars()
    shares = [F.col(c) for c in ("env_to_total_ratio", "social_to_total_ratio", "gov_to_total_ratio")]
    return df.withColumns({
        "env_to_total_ratio": eps_ratio(e, t), "social_to_total_ratio": eps_ratio(s, t), "gov_to_total_ratio": eps_ratio(g, t),
        "env_gov_ratio": eps_ratio(e, g), "env_social_ratio": eps_ratio(e, s), "social_gov_ratio": eps_ratio(s, g),
    }).withColumns({
        "pillar_imbalance_score": row_std(shares, sample=True),
        "dominant_pillar_strength": F.greatest(*shares), "weakest_pillar_weakness": F.least(*shares)})


def risk_decomposition(df: DataFrame) -> DataFrame:
    t, c, pillars = F.col(TOTAL), F.col(CONTROVERSY), _pillars()
    gap = F.greatest(*pillars) - F.least(*pillars)
    shares = [F.col(x) for x in ("env_to_total_ratio", "social_to_total_ratio", "gov_to_total_ratio")]
    return df.withColumns({
        "esg_risk_residual": t - total(pillars), "pillar_max_min_gap": gap, "pillar_range_normalized": eps_ratio(gap, t),
        "controversy_risk_ratio": eps_ratio(c, t), "controversy_adjusted_risk": t * (1.0 + c),
        "risk_concentration_index": total([x * x for x in shares])})


def moment_sums(columns: Sequence[str] = (TOTAL, CONTROVERSY)) -> dict[str, Column]:
    return {n: a for c in columns for n, a in ((f"{c}_mean", F.avg(c)), (f"{c}_std", F.stddev_samp(c)))}


def population_moments(df: DataFrame, columns: Sequence[str] = (TOTAL, CONTROVERSY)) -> DataFrame:
    return df.agg(*[a.alias(n) for n, a in moment_sums(columns).items()])


def statistical_moments(df: DataFrame, moments: dict | None = None) -> DataFrame:
    """``moments``: the figures of ``moment_sums`` where they are known already."""
    p = _pillars()
    mean = row_mean(p)
    m2 = row_var(p, sample=False)
    m3 = total([(x - mean) * (x - mean) * (x - mean) for x in p]) / 3.0
    # bias-corrected skew for n = 3: sqrt(n(n-1))/(n-2) = sqrt(6)
    skew = F.when(m2 > 1e-14, F.sqrt(F.lit(6.0)) * m3 / F.pow(m2, 1.5)).otherwise(0.0)
    z = {c: (F.col(c) - F.col(f"_mom.{c}_mean")) / (F.col(f"_mom.{c}_std") + EPS) for c in (TOTAL, CONTROVERSY)}
    return with_globals(df, population_moments(df) if moments is None else moments, "_mom").withColumns({
        "esg_pillar_mean": mean, "esg_pillar_variance": row_var(p, sample=True), "esg_pillar_skewness": skew,
        "esg_pillar_cv": eps_ratio(row_std(p, sample=True), mean),
        "esg_score_zscore": z[TOTAL], "controversy_zscore": z[CONTROVERSY],
        "esg_controversy_divergence": z[CONTROVERSY] - z[TOTAL]}).drop("_mom")


def interactions(df: DataFrame) -> DataFrame:
    t, c, (e, s, g) = F.col(TOTAL), F.col(CONTROVERSY), _pillars()
    return df.withColumns({
        "env_controversy_interaction": e * c, "social_controversy_interaction": s * c, "gov_controversy_interaction": g * c,
        "esg_squared": t * t, "controversy_squared": c * c, "imbalance_controversy_interact": F.col("pillar_imbalance_score") * c,
        "risk_per_pillar_point": eps_ratio(t, F.col("esg_pillar_mean") * 3.0),
        "env_dominance_flag": F.coalesce((e == F.greatest(e, s, g)).cast("int"), F.lit(0))})


QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def deviation_stats(df: DataFrame, medians: dict, columns: Sequence[str] = (TOTAL, CONTROVERSY), rows: int | None = None) -> dict:
    """Median absolute deviation per column, around known medians."""
    deviations = df.select(*[F.abs(F.col(c) - F.lit(medians[f"{c}_med"])).alias(c) for c in columns])
    return column_quantiles(deviations, columns, {"mad": 0.5}, rows=rows)


def robust_stats(df: DataFrame, columns: Sequence[str] = (TOTAL, CONTROVERSY)) -> dict[str, float | None]:
    """Exact quartiles, median and median absolute deviation per column."""
    found = figures(df, {c: QUARTILES for c in columns}, {"rows": F.count(F.lit(1))})
    rows = found.pop("rows")
    return {**found, **deviation_stats(df, found, columns, rows)}


def anomaly(df: DataFrame, with_rank: bool = True, base: DataFrame | None = None, robust: dict | None = None) -> DataFrame:
    """Needs the z-scores of ``statistical_moments``. ``base``: the same rows with a shorter lineage, for the statistics;
    ``robust``: the figures of ``robust_stats`` where they are known already."""
    base = df if base is None else base
    t, c = F.col(TOTAL), F.col(CONTROVERSY)

    def q(col: str, name: str) -> Column:
        return F.col(f"_r.{col}_{name}")

    def outside(v: Column, col: str) -> Column:
        iqr = q(col, "q3") - q(col, "q1")
        return (v < q(col, "q1") - 1.5 * iqr) | (v > q(col, "q3") + 1.5 * iqr)

    # a zero IQR on the controversy scale falls back to "differs from the median"
    controversy_out = F.when(q(CONTROVERSY, "q3") - q(CONTROVERSY, "q1") > 0, outside(c, CONTROVERSY)).otherwise(c != q(CONTROVERSY, "med"))
    out = with_globals(df, robust_stats(base) if robust is None else robust, "_r").withColumns({
        "esg_iqr_outlier": F.coalesce(outside(t, TOTAL).cast("int"), F.lit(0)),
        "controversy_iqr_outlier": F.coalesce(controversy_out.cast("int"), F.lit(0)),
        "esg_mad_score": eps_ratio(F.abs(t - q(TOTAL, "med")), q(TOTAL, "mad")),
        "controversy_mad_score": eps_ratio(F.abs(c - q(CONTROVERSY, "med")), q(CONTROVERSY, "mad"))}).drop("_r")
    out = out.withColumn("combined_anomaly_score", (
        0.25 * F.abs("esg_score_zscore") + 0.25 * F.abs("controversy_zscore") + 0.20 * F.col("esg_mad_score")
        + 0.20 * F.col("controversy_mad_score") + 0.10 * (F.col("esg_iqr_outlier") + F.col("controversy_iqr_outlier"))))
    if not with_rank:
        return out
    ranked = with_value_ranks(out, [], TOTAL, base)
    return ranked.withColumn("esg_percentile_rank", average_percentile()).drop("cnt", "below", "n")


def group_stats(df: DataFrame, group: str = "sector") -> DataFrame:
    return df.groupBy(group).agg(
        F.avg(TOTAL).alias("esg_sector_mean"), F.coalesce(F.stddev_samp(TOTAL), F.lit(0.0)).alias("esg_sector_std"),
        F.avg(CONTROVERSY).alias("controversy_sector_mean"))


def group_zscores(df: DataFrame, group: str = "sector", base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    out = attach_group(df, group_stats(base.filter(F.col(group).isNotNull()), group), [group])
    gap = F.col(TOTAL) - F.col("esg_sector_mean")
    return out.withColumns({
        "esg_vs_sector_mean": gap, "esg_sector_zscore": gap / (F.col("esg_sector_std") + EPS),
        "controversy_vs_sector": F.col(CONTROVERSY) - F.col("controversy_sector_mean")})


def group_ranks(df: DataFrame, group: str = "sector", value: str = TOTAL, base: DataFrame | None = None) -> DataFrame:
    """Competition rank and average-tie percentile inside the group; NULL groups get NULL."""
    ranked = with_value_ranks(df, [group], value, base)
    inside = F.col(group).isNotNull()
    return ranked.withColumns({"sector_rank": F.when(inside, F.col("below") + 1),
                               "sector_percentile": F.when(inside, average_percentile())}).drop("cnt", "below", "n")


def _scale_robust(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """Known quartiles go in as numbers: a row with a struct of them all is slow to compile and to run."""
    def known(c: str) -> tuple[Column, Column]:
        q1, med, q3 = (stats[f"{c}_{q}"] for q in QUARTILES)
        width = None if q1 is None else q3 - q1
        return F.lit(med).cast("double"), F.lit(1.0 if width == 0 else width).cast("double")

    return df.withColumns({f"{c}_scaled": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - center) / width
                           for c in columns for center, width in [known(c)]})


def _scale_by(df: DataFrame, columns: Sequence[str], stats, center: str, width) -> DataFrame:
    out = with_globals(df, stats, "_s")
    return out.withColumns({
        f"{c}_scaled": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_s.{c}_{center}"))
        / F.when(width(c) == 0, F.lit(1.0)).otherwise(width(c)) for c in columns}).drop("_s")


def scale(df: DataFrame, columns: Sequence[str], method: str = "robust", rows: int | None = None) -> DataFrame:
    """Append ``<column>_scaled``; NULL counts as 0, a zero width divides by 1. ``rows``: the row count where it is known."""
    columns = [c for c in columns if c in df.columns]
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if method == "standard":
        stats = filled.agg(*[a.alias(n) for c in columns for a, n in ((F.avg(c), f"{c}_mean"), (F.stddev_pop(c), f"{c}_sd"))])
        return _scale_by(df, columns, stats, "mean", lambda c: F.col(f"_s.{c}_sd"))
    if method == "minmax":
        stats = filled.agg(*[a.alias(n) for c in columns for a, n in ((F.min(c), f"{c}_lo"), (F.max(c), f"{c}_hi"))])
        return _scale_by(df, columns, stats, "lo", lambda c: F.col(f"_s.{c}_hi") - F.col(f"_s.{c}_lo"))
    if method == "robust":
        return _scale_robust(df, columns, column_quantiles(filled, columns, QUARTILES, rows=rows))
    if method == "power":
        return power_scale(df, columns)
    raise ValueError(f"unknown scaling method: {method}")


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1.0, lam) - 1.0) / lam
    low = F.greatest(-x, F.lit(0.0))
    down = -F.log1p(low) if abs(lam - 2) < 1e-12 else -(F.pow(low + 1.0, 2.0 - lam) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, up).otherwise(down)


def best_lambdas(df: DataFrame, columns: Sequence[str], grids: dict[str, list[float]]) -> dict[str, float]:
    """Maximum-likelihood power on a grid; the whole grid is one aggregate over the rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        x = F.col(c)
        aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{c}|j"))
        aggs += [F.var_pop(yeo_johnson(x, lam)).alias(f"{c}|{i}") for i, lam in enumerate(grids[c])]
    row = df.agg(*aggs).first()
    best = {}
    for c in columns:
        import math
        scored = [(-row["n"] / 2 * math.log(row[f"{c}|{i}"]) + (lam - 1) * row[f"{c}|j"], -i)
                  for i, lam in enumerate(grids[c]) if row[f"{c}|{i}"] and row[f"{c}|{i}"] > 0]
        best[c] = grids[c][-max(scored)[1]] if scored else 1.0
    return best


def power_scale(df: DataFrame, columns: Sequence[str], rounds: int = 4, lo: float = -2.0, hi: float = 4.0, step: float = 0.25) -> DataFrame:
    """Yeo-Johnson then standardization; each round narrows the grid around the best power."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    count = round((hi - lo) / step) + 1
    grids = {c: [lo + i * step for i in range(count)] for c in columns}
    best = best_lambdas(filled, columns, grids)
    for _ in range(rounds - 1):
        fine = step / 8
        grids = {c: [best[c] + (i - 8) * fine for i in range(17)] for c in columns}
        best, step = best_lambdas(filled, columns, grids), fine
    moved = df.withColumns({f"{c}_scaled": yeo_johnson(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), best[c]) for c in columns})
    stats = moved.agg(*[a.alias(n) for c in columns for a, n in (
        (F.avg(f"{c}_scaled"), f"{c}_mean"), (F.stddev_pop(f"{c}_scaled"), f"{c}_sd"))])
    out = with_globals(moved, stats, "_s")
    return out.withColumns({f"{c}_scaled": (F.col(f"{c}_scaled") - F.col(f"_s.{c}_mean"))
                            / F.when(F.col(f"_s.{c}_sd") == 0, 1.0).otherwise(F.col(f"_s.{c}_sd")) for c in columns}).drop("_s")


FEATURES = {
    "pillar_ratios": ["env_to_total_ratio", "social_to_total_ratio", "gov_to_total_ratio", "env_gov_ratio", "env_social_ratio",
                      "social_gov_ratio", "pillar_imbalance_score", "dominant_pillar_strength", "weakest_pillar_weakness"],
    "risk_decomposition": ["esg_risk_residual", "pillar_max_min_gap", "pillar_range_normalized", "controversy_risk_ratio",
                           "controversy_adjusted_risk", "risk_concentration_index"],
    "statistical_moments": ["esg_pillar_mean", "esg_pillar_variance", "esg_pillar_skewness", "esg_pillar_cv", "esg_score_zscore",
                            "controversy_zscore", "esg_controversy_divergence"],
    "interactions": ["env_controversy_interaction", "social_controversy_interaction", "gov_controversy_interaction", "esg_squared",
                     "controversy_squared", "imbalance_controversy_interact", "risk_per_pillar_point", "env_dominance_flag"],
    "anomaly": ["esg_iqr_outlier", "controversy_iqr_outlier", "esg_mad_score", "controversy_mad_score", "combined_anomaly_score",
                "esg_percentile_rank"],
    "sector_relative": ["esg_sector_mean", "esg_sector_std", "esg_vs_sector_mean", "esg_sector_zscore", "controversy_vs_sector",
                        "sector_rank", "sector_percentile"],
}
ALL_FEATURES = [f for fs in FEATURES.values() for f in fs]


def known_figures(df: DataFrame, quantiles: dict[str, dict[str, float]] | None = None) -> tuple[dict, int]:
    """Moments, quartiles and deviations of both scores, with further ``quantiles``, in two rounds; and the row count."""
    known = figures(df, {**(quantiles or {}), TOTAL: QUARTILES, CONTROVERSY: QUARTILES}, {**moment_sums(), "rows": F.count(F.lit(1))})
    rows = known.pop("rows")
    return {**known, **deviation_stats(df, known, rows=rows)}, rows


def all_numeric(df: DataFrame, scaled: bool = True) -> DataFrame:
    """Every numeric feature and, with ``scaled``, its robust-scaled copy; the features are staged for their quartiles."""
    known, rows = known_figures(df)
    out = (df.transform(pillar_ratios).transform(risk_decomposition).transform(statistical_moments, moments=known)
           .transform(interactions).transform(anomaly, base=df, robust=known).transform(group_zscores, base=df).transform(group_ranks, base=df))
    return scale(materialize(out), ALL_FEATURES, "robust", rows) if scaled else out
