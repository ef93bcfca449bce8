"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import hash_cell, prefix_positions, without

# fixed values: multiplier of the published generator, key <- key * MULTIPLIER + 1 (mod 2^64)
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1
_C1, _C0 = MULTIPLIER >> 32, MULTIPLIER & _LOW
#: jumps tried before the rare rest; a key needs about ln(shards) of them
QUICK_JUMPS = 16


def _times_low(value: Column, factor: int) -> Column:
    """Low 32 bits of value * factor, both below 2^32, without leaving 63 bits."""
    high = F.shiftright(value, 16) * factor
    return (value.bitwiseAND(0xFFFF) * factor + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def _jump(state: Column, shards: int) -> Column:
    """One jump; the 64-bit key is kept as two halves because ANSI arithmetic does not wrap."""
    hi, lo = state["hi"], state["lo"]
    part = F.shiftright(lo, 16) * _C0
    low = lo.bitwiseAND(0xFFFF) * _C0 + F.shiftleft(part.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(part, 16)
    high = (_times_low(hi, _C0) + _times_low(lo, _C1) + carry).bitwiseAND(_LOW)
    # 2^31 / ((key >> 33) + 1): the divisor is the top 31 bits plus one
    draw = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
    target = F.floor((state["j"] + 1).cast("double") * draw)
    moved = F.struct(high.alias("hi"), low.bitwiseAND(_LOW).alias("lo"), state["j"].alias("b"), target.cast("long").alias("j"))
    return F.when(state["j"] < shards, moved).otherwise(state)


def jump_state(key: Column, shards: int) -> Column:
    """Struct with ``b``, the shard among ``shards``, and ``j``, the next shard count at which the key would move."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"),
                     F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    quick = F.aggregate(F.sequence(F.lit(1), F.lit(min(QUICK_JUMPS, shards))), start, lambda s, _: _jump(s, shards))
    if shards <= QUICK_JUMPS:
        return quick
    # every jump moves up by one shard at least, so ``shards`` jumps always end
    return F.when(quick["j"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, _: _jump(s, shards))
                  ).otherwise(quick)


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``key``: the key and the shard count alone decide, and with one more shard (``grown_shard``) a row
    either stays or goes to the new one. Slots are gapless from 0 in each shard, in an order that depends on the
    rows only. Rows are neither dropped nor merged: repeated rows share a shard and get slots of their own. A null
    key counts as key 0, a null text has 16 bytes and the checksum of the empty text, an empty table stays empty.
    Input columns that clash with the added names give way.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    docs = without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_state", "_cell")
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.withColumn("_state", jump_state(F.col(key), shards)).select(
        "*", (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col("_state.b").cast("int").alias("shard"),
        F.when(F.col("_state.j") == shards, F.lit(shards)).otherwise(F.col("_state.b")).cast("int").alias("grown_shard")).drop("_state")
    return prefix_positions(placed, "shard", hash_cell(key), [F.col(key), F.col("text_crc32"), F.col("size")], "slot")
