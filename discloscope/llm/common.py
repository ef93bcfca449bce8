"""Column helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = " \t\n\x0b\x0c\r"
#: bytes of text that a task takes at a time
PORTION = 1 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash, in any case, with names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not their text; equal rows share it."""
    return F.xxhash64(doc_id, text)


def hash_cell(*names: str, cells: int = 1024) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(cells))


def prefix_positions(df: DataFrame, group: str, cell: Column, order: Sequence[Column], position: str, weight: str | None = None) -> DataFrame:
    """Adds a gapless position from 0 in each group or, with ``weight``, the sum of weights up to and including the row.

    A group never meets in one task: its rows fall into cells, are ordered inside each and shifted by the totals of
    earlier cells, one row a cell. The order of a group is (``cell``, ``order``). ``group`` must not be null.
    """
    df = df.withColumn("_cell", cell)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    earlier = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(group, "_cell").agg(total.alias("_total")).select(
        group, "_cell", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    local = F.row_number().over(inside) - 1 if weight is None else F.sum(weight).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("_local", local).join(offsets, [group, "_cell"])
    return out.select(*[c for c in df.columns if c != "_cell"], (F.col("_offset") + F.col("_local")).cast("long").alias(position))


def portions(batch: pa.RecordBatch, column: str, at_most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text, one row at least."""
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + at_most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
