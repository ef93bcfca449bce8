"""Raw documents to a sharded training corpus: each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloscope.llm.common import row_key, without
from discloscope.llm.decontamination import remove_contaminated
from discloscope.llm.jaccard_join import ngram_jaccard_join
from discloscope.llm.language_id import UNKNOWN, held_out, identify, train
from discloscope.llm.mixing import mix_sources
from discloscope.llm.sharding import assign_shards
from discloscope.session import materialize

#: a language this uncertain is rejected
MIN_SCORE = 0.5
SHARDS = 40


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letters, or a best guess below ``MIN_SCORE``."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    seen = identify(docs, model)
    return seen.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id, and of repeated rows one.

    Rows go by id and row key, so a row that shares its id with a copy stays. A row with a null id goes if another
    text with an id has its set of shingles; texts without words have no copies.
    """
    found = materialize(ngram_jaccard_join(docs).filter("n_shingles > 0 and component_id is not null").select("doc_id", "component_id", "row_key"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first"))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    copies = found.join(first, "component_id").filter(~F.coalesce(own, F.lit(False))).select(F.col("doc_id").alias("_copy"), F.col("row_key").alias("_copy_row")).distinct()
    plain = without(docs, "_copy", "_copy_row", "_row").withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    kept = plain.join(copies, (F.col("_row") == F.col("_copy_row")) & F.col("doc_id").eqNullSafe(F.col("_copy")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_row"]).drop("_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words, or more, stand in a passage of the benchmark."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their weights: documents over quota go, those of small sources may come twice."""
    return mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard and the slot in it to every row."""
    return assign_shards(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: language ID and the Jaccard join have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
