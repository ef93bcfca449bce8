"""Per-entity histories, linear forecasts and before/after comparisons, for all entities in one job.

A company has at most one panel row per calendar year, so windows and lists keyed by company stay tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloscope.functions.exprs import EPS, clip, row_std_skipna

def _ends(value: Column) -> tuple[Column, Column]:
    whole = Window.partitionBy("company_id")
    return F.min(value).over(whole), F.max(value).over(whole)


def entity_minmax(value: Column) -> Column:
    lo, hi = _ends(value)
    return (value - lo) / (hi - lo + EPS)


def risk_history(panel: DataFrame) -> DataFrame:
    out = panel.withColumns({
        "esg_risk_proxy": 100.0 - F.col("esg_overall"), "carbon_intensity": F.col("carbon_emissions") / (F.col("revenue") + EPS),
        "pillar_imbalance": row_std_skipna([F.col("esg_environmental"), F.col("esg_social"), F.col("esg_governance")])})
    out = out.withColumn("controversy_proxy", entity_minmax(F.col("carbon_intensity")) * 5.0)
    out = out.withColumn("divergence", F.col("controversy_proxy") - F.col("esg_risk_proxy") / 20.0)
    raw = (0.35 * F.col("esg_risk_proxy") + 0.25 * (F.col("controversy_proxy") * 20.0) + 0.20 * (F.col("pillar_imbalance") * 3.0)
           + 0.20 * (F.greatest(F.col("divergence"), F.lit(0.0)) * 15.0))
    out = out.withColumn("raw_risk", raw)
    lo, hi = _ends(F.col("raw_risk"))
    return out.withColumn("risk_score", F.when(hi > lo, (F.col("raw_risk") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 80.0 + 10.0).otherwise(50.0))


def linear_forecast(series: DataFrame, keys: Sequence[str], value: str, years: int = 3, floor: float | None = 0.0,
                    ceiling: float | None = 100.0) -> DataFrame:
    """Least squares on year (3 points or more), next years with a 1.96-sigma band from the residuals.

    The squared residuals come from the sums of squares, which combine before the shuffle, so no series is collected;
    what rounding leaves of a perfect fit counts as 0. Rows without a value or a year take no part in the fit.
    """
    y, x = F.col(value), F.col("year")
    fit = series.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.max("year").alias("last_year"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).filter("n >= 3")
    left = F.col("syy") - F.col("slope") * F.col("sxy")
    sigma = F.sqrt(F.when(left > F.col("syy") * 1e-13, left).otherwise(F.when(left.isNotNull(), 0.0)) / F.col("n"))
    out = fit.withColumn("sigma", sigma).withColumn(
        "year", F.explode(F.sequence(F.col("last_year") + 1, F.col("last_year") + F.lit(years))))
    point = F.col("intercept") + F.col("slope") * F.col("year")

    def bound(x: Column) -> Column:
        return x if floor is None else clip(x, floor, ceiling)

    return out.select(*keys, "year", bound(point).alias("forecast"), bound(point - 1.96 * F.col("sigma")).alias("lower_bound"),
                      bound(point + 1.96 * F.col("sigma")).alias("upper_bound"))


def first_last_change(history: DataFrame, value: str = "risk_score") -> DataFrame:
    out = history.groupBy("company_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by(value, "year").alias("first_value"),
        F.max_by(value, "year").alias("last_value"))
    change = F.col("last_value") - F.col("first_value")
    return out.withColumn("change", change).withColumn(
        "trend", F.when(change > 2, "INCREASING").when(change < -2, "DECREASING").otherwise("STABLE"))


BEFORE_AFTER = ["risk_score", "esg_overall", "esg_environmental", "esg_social", "esg_governance", "controversy_proxy",
                "carbon_emissions", "pillar_imbalance"]


def before_after(history: DataFrame, measures: Sequence[str] = BEFORE_AFTER) -> DataFrame:
    """Means before and from the middle year of each company with 3 years or more."""
    years = history.groupBy("company_id").agg(F.array_sort(F.collect_set("year")).alias("ys")).filter(F.size("ys") >= 3)
    pivots = years.select("company_id", F.element_at("ys", (F.floor(F.size("ys") / 2) + 1).cast("int")).alias("pivot_year"))
    long = history.join(pivots, "company_id").select(
        "company_id", "pivot_year", "year", *measures).unpivot(["company_id", "pivot_year", "year"], list(measures), "metric", "v")
    agg = long.groupBy("company_id", "pivot_year", "metric").agg(
        F.avg(F.when(F.col("year") < F.col("pivot_year"), F.col("v"))).alias("before"),
        F.avg(F.when(F.col("year") >= F.col("pivot_year"), F.col("v"))).alias("after"))
    change = F.col("after") - F.col("before")
    return agg.withColumns({"change": change, "change_pct": change / (F.abs("before") + EPS) * 100.0})


def forecast_direction(history: DataFrame, forecast: DataFrame) -> DataFrame:
    last = history.groupBy("company_id").agg(F.max_by("risk_score", "year").alias("last_actual"))
    end = forecast.groupBy("company_id").agg(F.max_by("forecast", "year").alias("final_forecast"))
    change = F.col("final_forecast") - F.col("last_actual")
    return end.join(last, "company_id").withColumn("change", change).withColumn(
        "direction", F.when(change > 2, "WORSENING").when(change < -2, "IMPROVING").otherwise("STABLE"))


def history_with_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actuals, one bridge point at the last actual, then the forecast."""
    actual = history.select("company_id", "year", "risk_score", F.lit("Actual").alias("type"))
    bridge = history.join(forecast.select("company_id").distinct(), "company_id", "left_semi").groupBy("company_id").agg(
        F.max("year").alias("year"), F.max_by("risk_score", "year").alias("risk_score"), F.lit("Bridge").alias("type"))
    ahead = forecast.select("company_id", "year", F.col("forecast").alias("risk_score"), F.lit("Forecast").alias("type"))
    return actual.unionByName(bridge).unionByName(ahead)
