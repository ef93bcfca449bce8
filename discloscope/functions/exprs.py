"""Scalar column helpers: bins, clips, guarded ratios, squashing, small in-row vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def cut(value: Column, edges: Sequence[float], labels: Sequence, right: bool = True,
        include_lowest: bool = False, default=None) -> Column:
    """Label by interval; ``right`` closes each interval on the right. Outside or NULL gives ``default``."""
    out = None
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        if right:
            low = value >= lo if include_lowest and i == 0 else value > lo
            test = low & (value <= hi)
        else:
            test = (value >= lo) & (value < hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def clip(value: Column, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL (``greatest``/``least`` alone would replace it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value)))


def guarded_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(default))


def eps_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


def squash(x: Column, k: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * x))


def soft_bound(s: Column) -> Column:
    return s / F.sqrt(s * s + 15.0)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Fixed small map as a literal; unmapped keys give ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: Sequence[Column]) -> Column:
    return total(cols) / float(len(cols))


def row_var(cols: Sequence[Column], sample: bool) -> Column:
    """Two-pass variance over a short fixed list of non-NULL columns."""
    mean = row_mean(cols)
    squares = total([(c - mean) * (c - mean) for c in cols])
    return squares / float(len(cols) - (1 if sample else 0))


def row_std(cols: Sequence[Column], sample: bool) -> Column:
    return F.sqrt(row_var(cols, sample))


def row_std_skipna(cols: Sequence[Column]) -> Column:
    """Sample deviation over the non-NULL members; NULL when fewer than two."""
    count = total([c.isNotNull().cast("int") for c in cols])
    mean = total([F.coalesce(c, F.lit(0.0)) for c in cols]) / F.nullif(count, F.lit(0))
    squares = total([F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    return F.when(count > 1, F.sqrt(squares / F.nullif(count - 1, F.lit(0))))


def normalized_entropy(cols: Sequence[Column], total_col: Column) -> Column:
    """Entropy of four shares, scaled to [0, 1]."""
    shares = [c / (total_col + EPS) for c in cols]
    return -total([p * F.log2(p + 1e-10) for p in shares]) / 2.0


def argmax(cols: Sequence[Column]) -> Column:
    """Index of the first maximum."""
    vec = F.array(*cols)
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    inf = float("inf")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(inf)), None).otherwise(value)


def with_globals(df: DataFrame, stats: DataFrame | dict, name: str = "_g") -> DataFrame:
    """Attach population figures as a struct column, without a join.

    A one-row DataFrame becomes a scalar subquery, which Spark runs once and hands to
    every task; a dict of known figures becomes literals.
    """
    if isinstance(stats, dict):
        row = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in stats.items()])
    else:
        row = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias(name)).scalar()
    return df.withColumn(name, row)
