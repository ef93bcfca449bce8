"""Line dedup across documents: explode, hash, count, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import BLANKS, ascii_lower, row_key, without
from discloscope.session import materialize


def line_keys(text: Column) -> Column:
    """Normalised lines of a text, in order; a null text is one empty line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is the line without outer white space and with A-Z lower-cased. A key of ``min_chars`` code points
    or more that is found in ``min_docs`` documents or more loses all its lines except in the largest ``doc_id``
    holding it. Keys are compared by two independent 64-bit hashes.

    Rows that share a ``doc_id`` count as one document, and repeated rows are kept as they are. Rows with a null
    ``doc_id`` are not counted and lose nothing. Null and empty texts have one empty line; ``kept_text`` is then
    empty. Input columns that clash with the added names give way.
    """
    docs = without(docs, "kept_text", "n_lines", "n_dropped", "_row", "_lines", "_cut", "_edges")
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    lines = lines.filter(F.length("key") >= min_chars).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # one row a document first, so a key that a third of all documents hold is spread before it is counted
    # written, so that the join below reads both its sides from a shuffle and a common line's rows can be split
    common = materialize(lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
                         .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n"))
    cuts = (lines.join(common, ["h1", "h2"]).filter(F.col("doc_id") < F.col("keeper"))
            .groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("_cut")))
    split = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text"))).join(
        cuts.withColumnRenamed("row", "_row"), "_row", "left").withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    n = F.size("_lines")
    # a flag a line, built from the gaps between cuts: time in proportion to the lines, also in very long documents
    flags = F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), F.col("_cut")), F.concat(F.col("_cut"), F.array(n)),
                                 lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))))
    stay = F.zip_with(F.col("_lines"), F.slice(flags, F.lit(1), n), lambda line, keep: F.when(keep, line))
    none = F.col("_cut").isNull()
    kept = F.when(none, F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return split.select(*docs.columns, kept.alias("kept_text"), n.cast("long").alias("n_lines"),
                        F.when(none, F.lit(0)).otherwise(F.size("_cut")).cast("long").alias("n_dropped"))
