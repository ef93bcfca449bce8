"""Token counts by source, language and tokenizer version, maintained from deltas in idempotent batches."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ["source", "lang", "version"]
TOTALS = "source string, lang string, version string, docs long, tokens long"
#: letters and digits, or single signs
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def piece_count(text: Column) -> Column:
    """Word and sign pieces of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("long")


def bpe_count(ranks_file: str, pattern: str) -> Callable[[Column], Column]:
    """A counter of byte-pair tokens, for a rank file that every executor can read under this path."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([len(coder.encode_ordinary(t or "")) for t in texts])
    return count


def deltas(events: DataFrame) -> DataFrame:
    """Signed changes of the totals from ``op`` (insert, delete, revise), ``tokens`` and, for a revision, ``old_tokens``.

    An insert adds a document and its tokens, a delete takes both away, a revision adds the difference of its counts.
    Null counts are 0, null source or language are groups of their own. Any other ``op`` raises an error when it
    runs. Sums are formed before the shuffle, so a group with a third of all events is a row a task.
    """
    now, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(unknown)
    tokens = F.when(F.col("op") == "insert", now).when(F.col("op") == "delete", -now).when(F.col("op") == "revise", now - old).otherwise(unknown)
    return events.groupBy(*GROUPS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class TokenRollup:
    """Totals in a folder that driver and executors share, one subfolder a batch.

    A batch is committed when its folder holds the success mark that Spark's writer leaves last. Committing a batch
    again does nothing, and what a lost run left without the mark is written anew, so every batch counts once however
    often it is sent. ``compact`` folds committed batches into one base that remembers their names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the batches and bases that are complete."""
        top, fs = self._path("")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(self._path(f"{n}/_SUCCESS")[0]))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds the batch unless it is in already; says whether it was added."""
        if f"batch-{batch}" in self.committed() or batch in self._folded():
            return False
        deltas(events).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def _bases(self) -> list[str]:
        return sorted((n for n in self.committed() if n.startswith("base-")), key=lambda n: int(n.split("-")[1]))

    def _folded(self) -> set[str]:
        bases = self._bases()
        if not bases:
            return set()
        rows = self.spark.read.parquet(f"{self.folder}/{bases[-1]}").filter("member is not null").select("member").collect()
        return {r["member"] for r in rows}  # one short name a batch

    def _live(self) -> list[str]:
        folded, bases = self._folded(), self._bases()
        return bases[-1:] + [n for n in self.committed() if n.startswith("batch-") and n.removeprefix("batch-") not in folded]

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``version``, ``docs``, ``tokens``; groups that came to nothing are left out."""
        live = [self.spark.read.parquet(f"{self.folder}/{n}").select(*GROUPS, "docs", "tokens") for n in self._live()]
        rows = reduce(DataFrame.union, live, self.spark.createDataFrame([], TOTALS))
        return rows.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds everything committed into the next base; the old folders stay, unread."""
        bases = self._bases()
        number = int(bases[-1].split("-")[1]) + 1 if bases else 1
        members = self._folded() | {n.removeprefix("batch-") for n in self._live() if n.startswith("batch-")}
        names = self.spark.createDataFrame([(m,) for m in sorted(members)], "member string")
        rows = self.totals().withColumn("member", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/base-{number}")


def corpus_batches(docs: DataFrame) -> dict[str, DataFrame]:
    """Change batches of a corpus: rough counts at arrival, exact ones later, copies taken out, a second tokenizer.

    ``words-1`` starts from a sixth of the characters, is revised to the words of the whole text, and loses every
    document whose text an earlier id has; ``pieces-1`` then counts what is left. A row with a null id is a document of
    its own and never a copy; rows that repeat the first id of a text all count; null sources and languages are groups
    like others. ``docs`` must be cheap to read again: ``doc_id``, ``source``, ``lang``, ``rough``, ``words``, ``pieces``,
    ``first_id``.
    """
    def events(rows: DataFrame, version: str, op: str, tokens: str, old: str | None = None) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(op).alias("op"), F.col(tokens).alias("tokens"),
                           (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return {"arrival": events(docs, "words-1", "insert", "rough"), "recount": events(docs, "words-1", "revise", "words", "rough"),
            "copies": events(docs.filter(copy), "words-1", "delete", "words"), "pieces": events(docs.filter(~copy), "pieces-1", "insert", "pieces")}
