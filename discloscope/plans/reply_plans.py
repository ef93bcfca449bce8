"""Model replies about reports, with the rules as the arm to fall back on."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloscope.operators import documents as D
from discloscope.plans import text_plans  # noqa: F401  (registers the CTEs of the rules)
from discloscope.plans.registry import cte, query
from discloscope.sources import adapters as A
from discloscope.sources import readers as R

MODEL_SQL = """
    SELECT doc_id, source AS overall_risk, CAST(n_chars % 101 AS INTEGER) AS overall_score FROM documents WHERE doc_id % 4 IN (0, 1)"""


def replies(spark, sf):
    """Replies are rendered from the documents: fenced JSON, JSON inside prose, malformed, empty. Then parsed."""
    d = A.table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    k, n = F.col("doc_id"), F.col("n_chars")
    body = F.to_json(F.struct(
        F.concat(F.lit("Company "), k).alias("company_name"), F.col("source").alias("overall_risk"), (n % 101).cast("int").alias("overall_score"),
        F.lit("Mixed.").alias("summary"),
        F.array(*[F.struct(F.concat(F.lit("claim "), n % 7 + i).alias("claim_text"), F.lit(c).alias("category"), F.lit(r).alias("risk_level"),
                           F.lit(issue).alias("issue"), F.lit("as said").alias("explanation"), F.lit(e).alias("evidence_type"))
                  for i, r, c, issue, e in ((0, "HIGH", "Environmental", "no target", "Vague Promise"), (1, "LOW", "Social", "measured", "Credible"))]).alias("claims"),
        F.array(F.lit("no target")).alias("red_flags"), F.array(F.lit("measured")).alias("positive_signals"),
        F.array(F.lit("set a target")).alias("recommendations")))
    reply = (F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k % 4 == 1, F.concat(F.lit("Here is my answer:\n"), body, F.lit("\nHope it helps.")))
             .when(k % 4 == 2, F.lit("{\"overall_risk\": ")).otherwise(F.lit("")))
    return d.select("doc_id", R.parse_reply(reply).alias("r")).select("doc_id", F.col("r").isNotNull().alias("answered"), *[
        c.alias(n) for n, c in R.reply_fields(F.col("r")).items()])


def unanswered(spark, sf, parsed):
    """Texts of the documents whose reply could not be parsed."""
    return A.corpus(spark, sf).join(parsed.filter("NOT answered").select("doc_id"), "doc_id", "left_semi")


@query("model_reply_parse", cte(f"""
    SELECT doc_id, 'model' AS arm, CAST(i AS INTEGER) AS claim_no, 'claim ' || (n_chars % 7 + i) AS claim_text, CASE WHEN i = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
           CASE WHEN i = 0 THEN 'Environmental' ELSE 'Social' END AS category, CASE WHEN i = 0 THEN 'no target' ELSE 'measured' END AS issue,
           CASE WHEN i = 0 THEN 'Vague Promise' ELSE 'Credible' END AS evidence_type
    FROM documents JOIN ({MODEL_SQL}) USING (doc_id), (SELECT unnest([0, 1]) AS i)
    UNION ALL SELECT doc_id, 'rules', sentence_no, claim_text, risk_level, category, issue, evidence_type FROM rep WHERE doc_id % 4 NOT IN (0, 1)""", "rep"))
def model_reply_parse(spark, sf):
    """Claims of every document: from its reply or, where that cannot be parsed, from the rules."""
    parsed = replies(spark, sf)
    fields = ["claim_text", "risk_level", "category", "issue", "evidence_type"]
    model = parsed.filter("answered").select("doc_id", F.lit("model").alias("arm"), F.posexplode("claims").alias("claim_no", "c"))
    rules = D.report_claims(unanswered(spark, sf, parsed), "doc_id", "description")
    return model.select("doc_id", "arm", "claim_no", *[f"c.{f}" for f in fields]).unionByName(
        rules.select("doc_id", F.lit("rules").alias("arm"), F.col("sentence_no").alias("claim_no"), *fields))


@query("reply_or_rules", cte(f"""
    SELECT doc_id, 'model' AS arm, 'Company ' || doc_id AS company_name, overall_risk, overall_score, 2::BIGINT AS n_claims, 'no target' AS red_flags, 'measured' AS positive_signals,
           'set a target' AS recommendations FROM ({MODEL_SQL})
    UNION ALL SELECT doc_id, 'rules', NULL, CASE WHEN overall_score >= 60 THEN 'HIGH' WHEN overall_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END, overall_score, n, rf, ps, NULL FROM (
        SELECT doc_id, coalesce(n, 0) AS n, CAST(least(100, floor(coalesce(h, 0) / greatest(coalesce(n, 0), 1) * 100 + 20)) AS INTEGER) AS overall_score,
               coalesce(rf, '') AS rf, coalesce(ps, '') AS ps
        FROM corpus LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE risk_level = 'HIGH') AS h,
             array_to_string(list(issue ORDER BY sentence_no) FILTER (WHERE risk_level = 'HIGH'), '|') AS rf,
             array_to_string(list(issue ORDER BY sentence_no) FILTER (WHERE risk_level = 'LOW'), '|') AS ps FROM rep GROUP BY doc_id) USING (doc_id) WHERE doc_id % 4 NOT IN (0, 1))""", "rep"))
def reply_or_rules(spark, sf):
    """One row a document with the arm it comes from."""
    parsed = replies(spark, sf)
    docs = unanswered(spark, sf, parsed)
    model = parsed.filter("answered").select(
        "doc_id", F.lit("model").alias("arm"), "company_name", "overall_risk", "overall_score", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("n_claims"),
        *[F.array_join(c, "|").alias(c) for c in ("red_flags", "positive_signals", "recommendations")])
    rules = D.report_summary(docs, D.report_claims(docs, "doc_id", "description"), "doc_id").select(
        "doc_id", F.lit("rules").alias("arm"), "overall_risk", "overall_score", "n_claims", "red_flags", "positive_signals")
    return model.unionByName(rules, allowMissingColumns=True)
