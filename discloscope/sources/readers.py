"""Typed readers, fallbacks, sinks and parsers for landed feeds and replies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.functions import fixed_values as V


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema; quoted fields may span lines."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', quote='"',
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).csv(
        path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_first_available(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """The first path that exists, else an empty table with the contract schema."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One Parquet table per name; returns the paths."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def lexicon_table(spark: SparkSession) -> DataFrame:
    rows = [(lex, term, float(w)) for lex, terms in V.LEXICONS.items() for term, w in terms.items()]
    return spark.createDataFrame(rows, "lexicon_id string, term string, weight double")


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(V.CLAIM_PATTERNS)]
    return spark.createDataFrame(
        rows, "priority int, pattern_name string, regex string, pillar string, claim_type string, description string")


def parse_feed(items: DataFrame, reference: dt.datetime, per_company: int | None = None) -> DataFrame:
    """Feed items to articles; an unreadable date becomes the reference time.

    Spark cannot parse weekday names, so the weekday is cut off first. All items are
    kept; the optional per-company limit of a page view is a rank filter, which Spark also applies before the shuffle.
    """
    ref = F.lit(reference)
    published = F.coalesce(F.try_to_timestamp(F.substring("pub_date", 6, 20), F.lit("dd MMM yyyy HH:mm:ss")), ref)
    if per_company is not None:
        order = Window.partitionBy("company_id").orderBy("item_no")
        items = items.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_company)
    return (items.select("company_id", "item_no",
                    F.regexp_replace(F.coalesce("title", F.lit("")), "<[^>]+>", "").alias("title"),
                    F.coalesce("source", F.lit("Unknown")).alias("source"),
                    F.coalesce("link", F.lit("")).alias("url"), published.alias("published"),
                    age_hours(published, ref).alias("age_hours")))


def age_hours(published: Column, reference: Column) -> Column:
    return (F.unix_micros(reference) - F.unix_micros(published)) / 3.6e9


#: fields of a feed item; attributes have a leading underscore
FEED_ITEM = "_company LONG, _no LONG, title STRING, source STRING, link STRING, pubDate STRING, _corrupt_record STRING"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed XML feeds, whatever stands around them; an item that is no XML keeps its text in ``raw``.

    Files are cut at the start of every item, so a feed of any size is read by many tasks and a broken item spoils no
    other one. What stands before the first item of a file is no item.
    """
    pieces = spark.read.text(path, lineSep="<item").filter(F.col("value").rlike(r"^[\s/>]") & ~F.col("value").rlike(r"^\s*(<|$)"))
    closed = F.coalesce(F.nullif(F.regexp_extract("value", r"(?s)^.*?</item>", 0), F.lit("")), F.nullif(F.regexp_extract("value", r"^[^>]*/>", 0), F.lit("")), F.col("value"))
    text = F.concat(F.lit("<item"), closed)
    # the constant explode keeps the optimiser from parsing once for every field
    items = pieces.select(F.from_xml(text, FEED_ITEM, {"mode": "PERMISSIVE", "rowTag": "item"}).alias("i")).select(F.explode(F.array("i")).alias("i"))
    return items.select(F.col("i._company").alias("company_id"), F.col("i._no").alias("item_no"), "i.title", "i.source", "i.link",
                        F.col("i.pubDate").alias("pub_date"), F.col("i._corrupt_record").alias("raw"))


# fixed values: fields of a reply and of its claims
REPLY_FIELDS = {"company_name": "string", "overall_risk": "string", "overall_score": "int", "summary": "string",
                "claims": "array<struct<claim_text:string,category:string,risk_level:string,issue:string,explanation:string,evidence_type:string>>",
                "red_flags": "array<string>", "positive_signals": "array<string>", "recommendations": "array<string>"}


def parse_reply(reply: Column) -> Column:
    """A reply without its code fences as a variant, else the outermost ``{...}`` of it, else NULL."""
    bare = F.trim(F.regexp_replace(reply, "```(?:json)?", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def reply_fields(parsed: Column) -> dict[str, Column]:
    """Typed fields of a parsed reply; one that is missing or of another type is NULL."""
    return {name: F.try_variant_get(parsed, f"$.{name}", kind) for name, kind in REPLY_FIELDS.items()}
