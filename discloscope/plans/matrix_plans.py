"""The whole feature pipeline as one query."""

from __future__ import annotations

from discloscope.operators import matrix as X
from discloscope.plans.cleaning_plans import clean_companies, scratch
from discloscope.plans.registry import CTES, cte, query
from discloscope.sources import adapters as A
from discloscope.sources.readers import write_tables

SOURCES = {"numerical": "num", "nlp": "nlp", "categorical": "cat"}
CTES["long_matrix"] = (("num", "nlp", "cat"), " UNION ALL ".join(
    f"SELECT {i} AS no, '{f}' AS feature, '{m}' AS module, company_id, CAST({f} AS DOUBLE) AS v FROM {SOURCES[m]}" for i, (f, m) in enumerate(X.DECLARED)))
CTES["per_feature"] = (("long_matrix",), """
    SELECT no, feature, module, count(DISTINCT v) <= 1 AS constant, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY company_id)) AS print,
           avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, count(*) - count(v) AS null_count FROM long_matrix GROUP BY no, feature, module""")


@query("feature_matrix", cte("""
    , s AS (SELECT *, CASE WHEN constant THEN 'constant' WHEN row_number() OVER (PARTITION BY print ORDER BY no) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM per_feature)
    SELECT feature, module, status, CASE WHEN status = 'kept' THEN mean END AS mean, CASE WHEN status = 'kept' THEN std END AS std,
           CASE WHEN status = 'kept' THEN min END AS min, CASE WHEN status = 'kept' THEN max END AS max, CASE WHEN status = 'kept' THEN null_count END AS null_count FROM s""", "per_feature"),
       "mean std min max", 4)
def feature_matrix(spark, sf):
    """Builds, checks and writes the matrix with its correlated pairs; returns the registry of all features."""
    kept, dropped, profile = checked(spark, sf)
    write_tables({"matrix": kept, "correlated": X.correlated(kept, profile)}, scratch(spark))
    return X.registry(kept, dropped, profile).drop("dtype")


def checked(spark, sf):
    texts = A.profile(spark, sf).select("company_id", "description")
    return X.quality_pass(X.build(A.material_issues(clean_companies(spark, sf)), texts))


@query("correlated_features", cte("""
    , s AS (SELECT no, feature FROM (SELECT *, row_number() OVER (PARTITION BY print ORDER BY no) AS rn FROM per_feature WHERE NOT constant) WHERE rn = 1),
    k AS (SELECT no, feature, company_id, coalesce(v, 0) AS v FROM long_matrix JOIN s USING (no, feature))
    SELECT l.feature AS left, r.feature AS right, corr(l.v, r.v) AS r FROM k l JOIN k r ON l.company_id = r.company_id AND l.no < r.no GROUP BY l.feature, r.feature HAVING abs(corr(l.v, r.v)) > 0.98""",
                                "per_feature"), "r", 4)
def correlated_features(spark, sf):
    """Pairs of kept features whose correlation is above 0.98 in either direction."""
    kept, _, profile = checked(spark, sf)
    return X.correlated(kept, profile)
