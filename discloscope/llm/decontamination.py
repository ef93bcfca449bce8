"""Benchmark decontamination: a hash set of test n-grams against every token window of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import ascii_lower, row_key, without
from discloscope.session import materialize

# fixed values: ASCII characters that part words
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: windows of the benchmark up to which their set is broadcast: about 100 bytes each, so under 300 MB
BROADCAST_WINDOWS = 2_000_000
#: words of a window that are looked up before the whole window
ANCHOR = 3


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    return F.filter(parts, lambda w: w != "")


def _anchors(length: Column, lengths: list[int]) -> Column:
    """Hash of the first words of every window of ``length`` words; higher-order functions are not compiled, so it is kept short."""
    starts = F.when(F.size("_hashes") >= length, F.sequence(F.lit(0), F.size("_hashes") - length)).otherwise(F.array().cast("array<int>"))

    def of(n: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(n)]))

    out = F
    for n in sorted({min(ANCHOR, x) for x in lengths}):
        out = out.when(F.least(length, F.lit(ANCHOR)) == n, of(n))
    return out


def _window_hash(at: Column, length: Column, lengths: list[int], seed: int = 0) -> Column:
    """Hash of the ``length`` word hashes from 0-based ``at`` on."""
    out = F
    for n in lengths:
        out = out.when(length == n, F.xxhash64(F.lit(seed), *[F.get(F.col("_hashes"), at + k) for k in range(n)]))
    return out


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct windows of all items: ``length``, ``gram`` (the words), the ``items`` that hold it and hashes."""
    words = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    words = words.withColumn("length", F.least(F.size("w"), F.lit(n)))
    grams = words.select("item_id", "length", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length")))).alias("gram"))
    grams = grams.groupBy("length", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    grams = grams.withColumn("_hashes", F.transform("gram", lambda w: F.xxhash64(w)))
    lengths = list(range(1, n + 1))
    anchor = F
    for k in range(1, ANCHOR + 1):
        anchor = anchor.when(F.least("length", F.lit(ANCHOR)) == k, F.xxhash64(*[F.get("_hashes", F.lit(j)) for j in range(k)]))
    return grams.select("length", F.array_join("gram", " ").alias("gram"), "items", anchor.alias("anchor"),
                        *[_window_hash(F.lit(0), F.col("length"), lengths, seed).alias(f"h{seed}") for seed in (0, 1)])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, unnamed: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``_row``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` and ``contaminated``.

    A window is ``n`` consecutive words of an item; a shorter item that has words is one window. Words inside any
    occurrence of a window are hit; a document is contaminated if it has hit words and they are at least one in
    ``share``. Windows are found by hash and then compared word by word.

    Rows equal in ``doc_id`` and text give one row; rows that share an id but not the text give one each, told apart
    by ``_row``. Null and empty texts have no words and no hits; items without words have no windows; an empty
    benchmark hits nothing. Items with a null id take no part or, if ``unnamed``, hit without being listed. Only ``doc_id``, ``text``, ``item_id`` are read.
    """
    grams = materialize(benchmark_windows(benchmark if unnamed else benchmark.filter(F.col("item_id").isNotNull()), n))
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect()) or [n]
    small = grams.count() <= BROADCAST_WINDOWS
    words = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), words_of(F.col("text")).alias("_words"))
    # the constant explode keeps the optimiser from pasting the split into every use of its result
    words = words.select("*", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("_length"))
    hashed = words.select("doc_id", "_row", "_words", "_length", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    hashed = hashed.select("*", F.explode(F.array(F.lit(0))).alias("_once"))
    # position 0 carries the document itself, so one scan also counts its words
    marks = F.concat(F.array(F.lit(None).cast("long")), _anchors(F.col("_length"), lengths))
    # From here to the hits all is compiled code, so a window does not copy the arrays of its document. The outer form
    # changes nothing, as there is always a mark, and stops the optimiser from pushing a test of the marks' size down.
    windows = hashed.withColumn("_marks", marks).select("doc_id", "_row", "_words", "_hashes", "_length", F.posexplode_outer("_marks").alias("_at", "_anchor"))
    hashes = [_window_hash(F.col("_at") - 1, F.col("_length"), lengths, seed).alias(f"_h{seed}") for seed in (0, 1)]
    kept = ["doc_id", "_row", "_length", "_at"]
    said = F
    for x in lengths:
        said = said.when(F.col("_length") == x, F.concat_ws(" ", *[F.get("_words", F.col("_at") - 1 + k) for k in range(x)]))
    if small:
        starts = F.broadcast(grams.select(F.col("anchor").alias("_anchor"), F.col("length").alias("_length"), F.lit(True).alias("_open")).distinct())
        found = windows.join(starts, ["_anchor", "_length"], "left").filter((F.col("_at") == 0) | F.col("_open"))
        held = F.broadcast(grams.select(F.col("h0").alias("_h0"), F.col("length").alias("_length"), "gram"))
        hits = found.select(*kept, "_words", F.when(F.col("_at") > 0, hashes[0]).alias("_h0")).join(held, ["_h0", "_length"], "left")
        hits = hits.filter((F.col("_at") == 0) | (F.col("gram").isNotNull() & (said == F.col("gram"))))
        hits = hits.select(*kept, F.when(F.col("_at") == 0, F.size("_words")).alias("_n"), "gram")
    else:
        # too many windows to send everywhere: theirs and the corpus's meet by shuffle of two hashes; the few that agree
        # meet the words of their documents again
        plain = windows.select(*kept, F.when(F.col("_at") == 0, F.size("_words")).alias("_n"),
                               *[F.when(F.col("_at") > 0, h).alias(f"_h{i}") for i, h in enumerate(hashes)])
        held = grams.select(F.col("h0").alias("_h0"), F.col("h1").alias("_h1"), F.col("length").alias("_length"), "gram")
        agreed = plain.filter("_at > 0").join(held, ["_h0", "_h1", "_length"]).select(*kept, "_n", "gram").distinct()
        texts = docs.select(F.col("doc_id").alias("_id"), row_key(F.col("doc_id"), F.col("text")).alias("_text_row"), words_of(F.col("text")).alias("_words"))
        texts = texts.dropDuplicates(["_id", "_text_row"])
        same = (F.col("_row") == F.col("_text_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        hits = agreed.join(texts, same).filter(said == F.col("gram")).select(*kept, "_n", "gram").unionByName(
            plain.filter("_at = 0").select(*kept, "_n", F.lit(None).cast("string").alias("gram")))
    spans = hits.groupBy("doc_id", "_row").agg(
        F.max("_n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("gram").isNotNull(), F.struct(F.col("_at").alias("a"), (F.col("_at") + F.col("_length")).alias("b"))))).alias("_spans"),
        F.collect_set("gram").alias("_grams"))
    covered = F.aggregate("_spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")))["n"]
    # read twice below; the windows of the corpus are gone through once
    spans = materialize(spans.select("doc_id", "_row", "n_words", covered.alias("n_hit"), "_spans", "_grams"))
    named = spans.filter(F.size("_grams") > 0).select("_row", "doc_id", F.explode("_grams").alias("gram"))
    items = grams.select("gram", "items")
    named = (named.join(F.broadcast(items) if small else items, "gram").select("_row", "doc_id", F.explode("items").alias("item"))
             .groupBy("_row", "doc_id").agg(F.sort_array(F.collect_set("item")).alias("item_ids")).drop("doc_id"))
    out = spans.join(named, "_row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "_row", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                      ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.col("_spans").alias("spans"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, unnamed: bool = False) -> DataFrame:
    """``docs`` without contaminated documents; all other rows and columns stay as they are."""
    found = contamination(docs, benchmark, n, share, unnamed).filter("contaminated").select(F.col("_row").alias("_hit_row"))
    docs = without(docs, "_hit_row")
    return docs.join(found, row_key(F.col("doc_id"), F.col("text")) == F.col("_hit_row"), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` whose ``text`` has lost the hit words: the rest is the remaining normalised words joined by spaces.

    Texts without hits stay unchanged.
    """
    found = contamination(docs, benchmark, n).filter("n_hit > 0").select(F.col("_row").alias("_hit_row"), F.col("spans").alias("_spans"))
    docs = without(docs, "_hit_row", "_spans")
    joined = docs.join(found, row_key(F.col("doc_id"), F.col("text")) == F.col("_hit_row"), "left")
    clean = F.array_join(F.filter(F.transform(words_of(F.col("text")), lambda w, i: F.when(
        ~F.exists("_spans", lambda s: (s["a"] <= i + 1) & (i + 1 < s["b"])), w)), lambda w: w.isNotNull()), " ")
    return joined.select(*[F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean).alias("text") if c == "text" else F.col(f"`{c}`")
                           for c in docs.columns])
