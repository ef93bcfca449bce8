"""The training-data operators as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloscope.llm import bpe
from discloscope.llm.decontamination import contamination
from discloscope.llm.hard_negatives import hard_negatives
from discloscope.llm.html_wrapper import extract_main_text
from discloscope.llm.jaccard_join import ngram_jaccard_join
from discloscope.llm.language_id import held_out, identify, train
from discloscope.llm.line_dedup import dedup_lines
from discloscope.llm.mixing import mix_sources, word_count
from discloscope.llm.preference import format_preferences, reply_swaps
from discloscope.llm.sharding import assign_shards
from discloscope.llm.token_rollup import PIECES, TokenRollup, corpus_batches, piece_count
from discloscope.llm.topk import exact_top_k
from discloscope.llm.word_runs import word_runs
from discloscope.session import materialize, staging_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def spans(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


# ---------------------------------------------------------------- 1
def _side_sql(name: str, turns: str) -> str:
    """Completion and spans of the turns after the prompt, with a running length for the spans."""
    return f"""
    SELECT conv_id, coalesce(string_agg(head || body, '' ORDER BY i), '') AS {name}_completion,
           coalesce(string_agg((ends - length(body)) || '-' || ends, ',' ORDER BY i) FILTER (role = 'assistant'), '') AS {name}_spans
    FROM (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id ORDER BY i) AS ends
          FROM (SELECT conv_id, i, t.role AS role, '<|' || t.role || '|>' || chr(10) AS head, replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body
                FROM (SELECT conv_id, n, unnest({turns}) AS t, unnest(range(1, len({turns}) + 1)) AS i FROM m) WHERE i > n))
    GROUP BY conv_id"""


@query("op1_preference_format", f"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS c FROM u GROUP BY conv_id),
a AS (SELECT *, len(c) - list_position(list_reverse(list_transform(c, lambda t: t.role)), 'assistant') + 1 AS last FROM l
      WHERE list_contains(list_transform(c, lambda t: t.role), 'assistant')),
s AS (SELECT a.conv_id, a.c, list_transform(a.c, lambda t, i: CASE WHEN i = a.last THEN {{'role': t.role, 'text': coalesce(o.c[o.last].text, '')}} ELSE t END) AS r
      FROM a LEFT JOIN a AS o ON o.conv_id = a.conv_id + 1),
m AS (SELECT conv_id, c, r, (SELECT coalesce(min(i) - 1, len(c)) FROM unnest(range(1, len(c) + 1)) AS x(i) WHERE c[i] IS DISTINCT FROM r[i]) AS n FROM s),
p AS (SELECT conv_id, n, coalesce(array_to_string(list_transform(c[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)), ''), '') AS prompt
      FROM m),
x AS ({_side_sql("chosen", "c")}),
y AS ({_side_sql("rejected", "r")})
SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns, prompt, coalesce(chosen_completion, '') AS chosen_completion, coalesce(chosen_spans, '') AS chosen_spans,
       coalesce(rejected_completion, '') AS rejected_completion, coalesce(rejected_spans, '') AS rejected_spans
FROM p LEFT JOIN x USING (conv_id) LEFT JOIN y USING (conv_id)""")
def op1(spark, sf_dir):
    pairs = format_preferences(reply_swaps(table(spark, sf_dir, "conversations")))
    return pairs.select("conv_id", "n_prompt_turns", "prompt", "chosen_completion", spans("chosen_spans").alias("chosen_spans"),
                        "rejected_completion", spans("rejected_spans").alias("rejected_spans"))


# ---------------------------------------------------------------- 2
@query("op2_mix_sources", r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, 'null') AS s, md5(CAST(doc_id AS VARCHAR)) AS k,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
z AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS size FROM d GROUP BY s HAVING sum(tokens) > 0),
p AS (SELECT s, size, size / CAST(sum(size) OVER () AS DOUBLE) AS p, CAST(sum(size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM z),
e(step, lo, hi) AS (
    SELECT 0, CASE WHEN (SELECT -sum(p * ln(p)) / ln(max(n)) FROM p WHERE n > 1) < 0.95 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN h >= 0.95 THEN mid ELSE lo END, CASE WHEN h >= 0.95 THEN hi ELSE mid END
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                 (SELECT (ln(sum(p ** ((lo + hi) / 2))) - ((lo + hi) / 2) * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2))) / ln(max(n)) FROM p) AS h
          FROM e WHERE step < 60)),
x AS (SELECT lo AS a FROM e WHERE step = 60),
r(step, lo, hi) AS (
    SELECT 0, a, CASE WHEN (SELECT max(p ** (a - 1)) / sum(p ** a) FROM p) > 2.0 THEN 1.0::DOUBLE ELSE a END FROM x
    UNION ALL
    SELECT step + 1, CASE WHEN m <= 2.0 THEN lo ELSE mid END, CASE WHEN m <= 2.0 THEN mid ELSE hi END
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(p ** ((lo + hi) / 2 - 1)) / sum(p ** ((lo + hi) / 2)) FROM p) AS m
          FROM r WHERE step < 60)),
q AS (SELECT s, size, CAST(round(p ** a / sum(p ** a) OVER () * total) AS BIGINT) AS quota
      FROM p, (SELECT hi AS a FROM r WHERE step = 60)),
c AS (SELECT doc_id, d.s, k, tokens, size, quota, sum(tokens) OVER (PARTITION BY d.s ORDER BY k, doc_id) - tokens AS before
      FROM d JOIN q USING (s)),
u AS (SELECT *, CASE WHEN tokens = 0 THEN least(full_copies, 1) ELSE full_copies END AS copies
      FROM (SELECT *, quota // size + CASE WHEN before < quota % size THEN 1 ELSE 0 END AS full_copies FROM c)),
f AS (SELECT *, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM u)
SELECT doc_id, CASE WHEN s = 'null' THEN NULL ELSE s END AS source, tokens, CAST(epoch AS INTEGER) AS epoch,
       CAST(least(floor((epoch * size + before) / CAST(quota AS DOUBLE) * 64), 63) AS INTEGER) AS block, md5(epoch || '/' || k) AS block_order
FROM f""")
def op2(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "epoch", "block", "block_order")


# ---------------------------------------------------------------- 3
@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SPLIT = rf"string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op4_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, list_filter({SPLIT}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({SPLIT}, lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM o JOIN g USING (n, gram)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op4(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


# ---------------------------------------------------------------- 5
@query("op5_jump_shards")
def op5(spark, sf_dir):
    placed = assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# ---------------------------------------------------------------- 6
@query("op6_token_counts", rf"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents)
SELECT source, lang, 'words-1' AS version, count(*) AS docs,
       CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS tokens
FROM d WHERE doc_id = first_id OR doc_id IS NULL GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*), CAST(sum(coalesce(len(regexp_extract_all(text, '{PIECES}')), 0)) AS BIGINT)
FROM d WHERE doc_id = first_id OR doc_id IS NULL GROUP BY source, lang""")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("doc_id", "source", "lang", F.floor(F.length(text) / 6).alias("rough"), word_count(F.col("text")).alias("words"),
                         piece_count(F.col("text")).alias("pieces"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    counts = materialize(counts)
    first = counts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    counts = materialize(counts.join(materialize(first), ["h1", "h2"]).drop("h1", "h2"))
    rollup = TokenRollup(spark, f"{staging_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batches = corpus_batches(counts)
    for name in [*batches, "recount"]:  # the batch that comes twice counts once
        rollup.commit(name, batches[name])
    return rollup.totals()


# ---------------------------------------------------------------- 7
@query("op7_line_dedup", f"""
WITH l AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {TRIM}) AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY doc_id""")
def op7(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


# ---------------------------------------------------------------- 8
@query("op8_html_extraction")
def op8(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# ---------------------------------------------------------------- 9
@query("op9_language_id")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = train(docs.filter(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


# ---------------------------------------------------------------- 10
@query("op10_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT * FROM (
    SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
           c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 5""")
def op10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


# ---------------------------------------------------------------- 11
@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    # the words up to a, then the p words from a on again and again
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    periodic = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), n - F.col("a")))
    docs = docs.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
    found = word_runs(docs)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ---------------------------------------------------------------- 12
@query("op12_hard_negatives", """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5""")
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


# ---------------------------------------------------------------- 13
@query("op13_bpe_round_trip")
def op13(spark, sf_dir):
    import public_tokenizers
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    both = bpe.decode(coded, vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
