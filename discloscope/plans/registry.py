"""Query registration and the SQL building blocks shared by the checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.sources.adapters import HEADLINES, SEED_SENTENCES


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def nudge(places: int) -> float:
    """Far below the kept places; moves exact decimal ties off the rounding edge."""
    return 1.37e-3 * 10.0 ** -places


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so sums taken in another order compare equal."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") + F.lit(nudge(places)), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``doubles`` lists the SQL columns to round."""
    if sql is not None and doubles:
        fixes = ", ".join(f"round(CAST({c} AS DOUBLE) + {nudge(places)!r}::DOUBLE, {places}) + 0.0 AS {c}" for c in doubles.split())
        sql = f"SELECT * REPLACE ({fixes}) FROM ({sql}) AS _q"

    def register(fn):
        QUERIES[name] = Query(lambda spark, sf_dir: rounded(fn(spark, sf_dir), places), sql)
        return fn
    return register


# ---------------------------------------------------------------- SQL building blocks
def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def seed_sql(key: str) -> str:
    return f"{text_list(SEED_SENTENCES)}[CAST({key} % 12 AS INTEGER) + 1]"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {text(str(k))} THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


def sigmoid_sql(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def unpivot_sql(source: str, ids: str, cols: Sequence[str], name: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {source}" for c in cols)


def pillar_sql(mult: int, mod: int) -> str:
    return f"CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * {mult} % {mod}) / 10.0 END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), f"""
        SELECT doc_id, lang, source, coalesce(text, '') || ' ' || {seed_sql('doc_id')} AS description FROM documents"""),
    "profile": ((), f"""
        SELECT p_partkey AS company_id, 'SYM' || p_partkey AS symbol, upper(p_name || '-' || p_partkey) AS company_name,
               p_type AS sector, p_brand AS industry,
               CASE WHEN d.text IS NOT NULL OR p_partkey % 10 <> 9
                    THEN coalesce(d.text, '') || ' ' || {seed_sql('p_partkey')} END AS description,
               CAST(p_size AS DOUBLE) * (CASE WHEN p_partkey % 97 = 0 THEN 4 ELSE 1 END) AS total_esg_risk_score,
               CAST({pillar_sql(7919, 200)} AS DOUBLE) AS env_risk_score,
               CAST({pillar_sql(104729, 180)} AS DOUBLE) AS social_risk_score,
               CAST({pillar_sql(1299709, 150)} AS DOUBLE) AS gov_risk_score,
               CAST(p_partkey % 5 + 1 AS DOUBLE) AS controversy_score,
               CASE WHEN p_partkey % 10 = 0 THEN 'B' ELSE 'A' END AS source
        FROM part LEFT JOIN documents d ON d.doc_id = p_partkey"""),
    "clean": (("profile",), """
        SELECT * REPLACE (
            coalesce(env_risk_score, (SELECT quantile_cont(env_risk_score, 0.5) FROM profile)) AS env_risk_score,
            coalesce(social_risk_score, (SELECT quantile_cont(social_risk_score, 0.5) FROM profile)) AS social_risk_score,
            coalesce(gov_risk_score, (SELECT quantile_cont(gov_risk_score, 0.5) FROM profile)) AS gov_risk_score)
        FROM profile"""),
    "issues": (("profile",), """
        SELECT company_id,
               CASE company_id % 3 WHEN 0 THEN 'Carbon - Own Operations' WHEN 1 THEN 'Business Ethics' END AS material_issue_1,
               CASE company_id % 4 WHEN 0 THEN 'Human Capital' WHEN 1 THEN 'Corporate Governance' END AS material_issue_2,
               CASE WHEN company_id % 5 = 0 THEN 'Occupational Health' END AS material_issue_3
        FROM profile"""),
    "raw_rating": ((), """
        SELECT p_partkey AS company_id,
               CASE WHEN p_partkey % 2 = 1 THEN '  ' || lower(p_name || '-' || p_partkey) || chr(9)
                    ELSE p_name || '-' || p_partkey END AS name,
               'SYM' || p_partkey AS symbol, p_type AS sector, p_brand AS industry,
               CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE format('{:,}', p_partkey * 37) END AS employees,
               CASE WHEN p_partkey % 33 = 0 THEN 'none' ELSE (p_partkey % 100) || 'th percentile' END AS percentile,
               CASE WHEN p_size < 10 THEN 'Negligible' WHEN p_size < 20 THEN 'Low' WHEN p_size < 30 THEN 'Medium'
                    WHEN p_size < 40 THEN 'High' WHEN p_size < 50 THEN 'Severe' ELSE 'Unrated' END AS risk_level,
               ['None Controversy Level', 'Low Controversy Level', 'Moderate Controversy Level',
                'Significant Controversy Level', 'High Controversy Level', 'Severe Controversy Level',
                'Other'][CAST(p_partkey % 7 AS INTEGER) + 1] AS controversy_level,
               ['Low', 'Medium', 'High'][CAST(p_partkey % 3 AS INTEGER) + 1] AS exposure,
               ['Weak', 'Average', 'Strong', 'n/a'][CAST(p_partkey % 4 AS INTEGER) + 1] AS management,
               CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS total_score,
               CAST(p_size AS DOUBLE) AS score_current, CAST(p_size + p_partkey % 7 AS DOUBLE) AS score_forecast
        FROM part"""),
    "graded": ((), """
        SELECT s_suppkey AS supplier_id,
               CASE WHEN s_suppkey % 3 = 0 THEN ' sym' || s_suppkey ELSE 'NEW' || s_suppkey END AS ticker,
               s_name AS name, 'brand#' || (s_suppkey % 27) AS industry,
               ['A', 'AA', 'BBB', 'BB', 'B', 'C', 'N/A'][CAST(s_suppkey % 7 AS INTEGER) + 1] AS total_grade,
               CAST(150 + s_suppkey * 31 % 600 AS DOUBLE) AS environment_score,
               CAST(100 + s_suppkey * 47 % 620 AS DOUBLE) AS social_score,
               CAST(50 + s_suppkey * 13 % 450 AS DOUBLE) AS governance_score,
               CAST(500 + s_suppkey * 71 % 1100 AS DOUBLE) AS total_score
        FROM supplier"""),
    "panel": ((), """
        SELECT o_custkey AS company_id, c_name AS company_name, c_mktsegment AS industry, r_name AS region, year, revenue,
               revenue / lag(revenue) OVER (PARTITION BY o_custkey ORDER BY year) - 1 AS growth_rate,
               (esg_environmental + esg_social + esg_governance) / 3.0 AS esg_overall,
               esg_environmental, esg_social, esg_governance, carbon_emissions, water_usage, energy_consumption
        FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS revenue,
                     round(1000 * avg(l_discount), 6) AS esg_environmental, round(1250 * avg(l_tax), 6) AS esg_social,
                     round(2 * avg(l_quantity), 6) AS esg_governance, sum(l_quantity) AS carbon_emissions,
                     round(sum(l_quantity * l_tax), 4) AS water_usage, CAST(count(*) AS DOUBLE) AS energy_consumption
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) t
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "articles": ((), f"""
        SELECT user_id AS company_id, event_id AS article_id, ts AS published, event_type AS source,
               'u/' || user_id || '/' || event_id AS url,
               replace({text_list(HEADLINES)}[CAST(event_id % 4 AS INTEGER) + 1], '{{}}',
                       upper(event_type[1]) || lower(event_type[2:])) AS title
        FROM events"""),
    "pred": ((), """
        SELECT doc_id AS id, CAST(quality AS INTEGER) AS y, (n_chars % 97) / 96.0::DOUBLE AS p1,
               (doc_id * 37 % 101) / 100.0::DOUBLE AS p2, (doc_id * 53 % 89) / 88.0::DOUBLE AS p3,
               CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
        FROM labels JOIN documents USING (doc_id)"""),
    "pred_long": (("pred",), """
        SELECT id, y, split, 'p1' AS model, p1 AS p FROM pred UNION ALL SELECT id, y, split, 'p2', p2 FROM pred
        UNION ALL SELECT id, y, split, 'p3', p3 FROM pred"""),
}


def cte(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and whatever they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head} {body}"
