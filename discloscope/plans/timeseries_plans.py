"""Panel histories, forecasts and comparisons as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloscope.operators import timeseries as S
from discloscope.operators.relational import melt
from discloscope.plans.registry import CTES, cte, query, unpivot_sql
from discloscope.session import materialize
from discloscope.sources import adapters as A

PIL = "list_stddev_samp([esg_environmental, esg_social, esg_governance])"
CTES["h1"] = (("panel",), f"""
    SELECT *, 100 - esg_overall AS esg_risk_proxy, {PIL} AS pillar_imbalance,
           (ci - min(ci) OVER w) / (max(ci) OVER w - min(ci) OVER w + 1e-8) * 5 AS controversy_proxy
    FROM (SELECT *, carbon_emissions / (revenue + 1e-8) AS ci FROM panel) WINDOW w AS (PARTITION BY company_id)""")
CTES["h2"] = (("h1",), """
    SELECT *, 0.35 * esg_risk_proxy + 0.25 * (controversy_proxy * 20) + 0.2 * (pillar_imbalance * 3)
              + 0.2 * (greatest(controversy_proxy - esg_risk_proxy / 20, 0) * 15) AS raw FROM h1""")
CTES["hist"] = (("h2",), """
    SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) * 80 + 10 ELSE 50 END AS risk_score
    FROM h2 WINDOW w AS (PARTITION BY company_id)""")


def history(spark, sf):
    return S.risk_history(A.panel(spark, sf))


@query("entity_minmax", cte("SELECT company_id, year, (revenue - min(revenue) OVER w) / (max(revenue) OVER w - min(revenue) OVER w + 1e-8) AS scaled FROM panel WINDOW w AS (PARTITION BY company_id)", "panel"), "scaled")
def entity_minmax(spark, sf):
    return A.panel(spark, sf).select("company_id", "year", S.entity_minmax(F.col("revenue")).alias("scaled"))


@query("risk_history", cte("SELECT company_id, year, risk_score, controversy_proxy, pillar_imbalance FROM hist", "hist"), "risk_score controversy_proxy pillar_imbalance", 4)
def risk_history(spark, sf):
    return history(spark, sf).select("company_id", "year", "risk_score", "controversy_proxy", "pillar_imbalance")


@query("first_last_change", cte("""
    SELECT company_id, first_year, last_year, fv AS first_value, lv AS last_value, lv - fv AS change, CASE WHEN lv - fv > 2 THEN 'INCREASING' WHEN lv - fv < -2 THEN 'DECREASING' ELSE 'STABLE' END AS trend
    FROM (SELECT company_id, min(year) AS first_year, max(year) AS last_year, arg_min(risk_score, year) AS fv, arg_max(risk_score, year) AS lv FROM hist GROUP BY company_id)""", "hist"), "first_value last_value change", 4)
def first_last_change(spark, sf):
    return S.first_last_change(history(spark, sf))


@query("event_before_after", cte(f"""
    SELECT company_id, pivot_year, metric, b AS before, a AS after, a - b AS change, (a - b) / (abs(b) + 1e-8) * 100 AS change_pct
    FROM (SELECT company_id, pivot_year, metric, avg(v) FILTER (WHERE year < pivot_year) AS b, avg(v) FILTER (WHERE year >= pivot_year) AS a
          FROM ({unpivot_sql('hist', 'company_id, year', S.BEFORE_AFTER, 'metric', 'v')})
          JOIN (SELECT company_id, ys[CAST(floor(len(ys) / 2) AS INTEGER) + 1] AS pivot_year FROM (SELECT company_id, list_sort(list(DISTINCT year)) AS ys FROM panel GROUP BY company_id) WHERE len(ys) >= 3) USING (company_id)
          GROUP BY ALL)""", "hist"), "before after change change_pct", 3)
def event_before_after(spark, sf):
    return S.before_after(materialize(history(spark, sf)))


FIT = """
    SELECT {keys}, CAST(ly + k AS INTEGER) AS year, {clip_p} AS forecast, {clip_l} AS lower_bound, {clip_u} AS upper_bound
    FROM (SELECT {keys}, ly, k, ic + sl * (ly + k) AS pt, sg FROM (
        SELECT {keys}, any_value(ly) AS ly, any_value(sl) AS sl, any_value(ic) AS ic, stddev_pop({v} - (ic + sl * year)) AS sg
        FROM (SELECT {keys}, year, {v}, regr_slope({v}, year) OVER w AS sl, regr_intercept({v}, year) OVER w AS ic, max(year) OVER w AS ly, count({v}) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY {keys}))
        WHERE n >= 3 GROUP BY {keys}), (SELECT unnest([1, 2, 3]) AS k))"""


def fit_sql(src, keys, v, clip=True):
    def c(x):
        return f"least(greatest({x}, 0), 100)" if clip else x
    return FIT.format(src=src, keys=keys, v=v, clip_p=c("pt"), clip_l=c("pt - 1.96 * sg"), clip_u=c("pt + 1.96 * sg"))


CTES["fc"] = (("hist",), fit_sql("hist", "company_id", "risk_score"))


@query("linear_forecast", cte("SELECT * FROM fc", "fc"), "forecast lower_bound upper_bound", 4)
def linear_forecast(spark, sf):
    return S.linear_forecast(history(spark, sf), ["company_id"], "risk_score")


MULTI = ["esg_overall", "carbon_emissions", "revenue"]


@query("multi_metric_forecast", cte(f", l AS ({unpivot_sql('panel', 'company_id, year', MULTI, 'metric', 'value')}) SELECT company_id, metric, year, forecast FROM ({fit_sql('l', 'company_id, metric', 'value', clip=False)})", "panel"), "forecast", 3)
def multi_metric_forecast(spark, sf):
    long = melt(A.panel(spark, sf), ["company_id", "year"], MULTI)
    return S.linear_forecast(long, ["company_id", "metric"], "value", floor=None).select("company_id", "metric", "year", "forecast")


@query("forecast_direction", cte("""
    SELECT company_id, ff AS final_forecast, la AS last_actual, ff - la AS change, CASE WHEN ff - la > 2 THEN 'WORSENING' WHEN ff - la < -2 THEN 'IMPROVING' ELSE 'STABLE' END AS direction
    FROM (SELECT company_id, arg_max(forecast, year) AS ff FROM fc GROUP BY company_id) JOIN (SELECT company_id, arg_max(risk_score, year) AS la FROM hist GROUP BY company_id) USING (company_id)""", "fc"),
       "final_forecast last_actual change", 4)
def forecast_direction(spark, sf):
    h = materialize(history(spark, sf).select("company_id", "year", "risk_score"))
    return S.forecast_direction(h, S.linear_forecast(h, ["company_id"], "risk_score"))


@query("history_forecast_union", cte("""
    SELECT company_id, year, risk_score, 'Actual' AS type FROM hist UNION ALL
    SELECT company_id, max(year), arg_max(risk_score, year), 'Bridge' FROM hist WHERE company_id IN (SELECT company_id FROM fc) GROUP BY company_id UNION ALL
    SELECT company_id, year, forecast, 'Forecast' FROM fc""", "fc"), "risk_score", 4)
def history_forecast_union(spark, sf):
    h = materialize(history(spark, sf).select("company_id", "year", "risk_score"))
    return S.history_with_forecast(h, S.linear_forecast(h, ["company_id"], "risk_score"))
