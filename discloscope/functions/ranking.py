"""Exact ranks, cumulative counts and quantiles without a one-task window.

A plain ``rank() over (order by v)`` sends every row of a group to one task. Here
rows are first reduced to distinct ``(group, value)`` with counts (map-side combine
absorbs repeated values), cut into value ranges so that no unit holds more than a
slice of the data, ranked inside each unit, and shifted by the totals of the lower
units. The cut points only balance the work; the result does not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloscope.session import materialize

#: value ranges of a ranking follow the rows, within these numbers
ROWS_PER_SLICE = 1_000_000
SLICES = (8, 256)
SMALL_SIDE_ROWS = 20_000
#: counted tables of at most so many rows take Spark's exact percentile, which holds a column's distinct values in one task
EXACT_ROWS = 100_000
#: figures of more columns than this are selected from counts of value ranges, see ``_selected``
WIDE = 8


def cut_points(df: DataFrame, value: str, rows_per_slice: int = ROWS_PER_SLICE) -> list[float]:
    """Approximate split points of ``value``, one for about ``rows_per_slice`` rows; one row reaches the driver."""
    least, most = SLICES
    row = df.agg(F.percentile_approx(value, [i / most for i in range(1, most)], 10_000).alias("p"), F.count(value).alias("n")).first()
    step = most // min(most, max(least, 1 << (row["n"] // rows_per_slice).bit_length()))
    return sorted({float(x) for x in (row["p"] or [])[step - 1::step]})


def slice_of(value: Column, cuts: Sequence[float]) -> Column:
    """Index of the value range, found by binary descent over the literal cut points."""
    def descend(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), descend(lo, mid)).otherwise(descend(mid + 1, hi))
    return descend(0, len(cuts))


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, weights: dict[str, Column] | None = None,
                cuts: Sequence[float] | None = None) -> DataFrame:
    """Per distinct non-NULL ``(groups, value)``: ``cnt``, ``below`` (rows strictly smaller) and group size ``n``.

    ``weights`` adds further summed measures; each ``w`` also yields ``below_w`` and ``n_w``.
    """
    weights = weights or {}
    groups = list(groups)
    rows = df.filter(F.col(value).isNotNull())
    if cuts is None:
        cuts = cut_points(rows, value)
    measures = {"cnt": F.count(F.lit(1)), **{k: F.sum(w) for k, w in weights.items()}}
    names = {"cnt": ("below", "n"), **{k: (f"below_{k}", f"n_{k}") for k in weights}}
    distinct = (rows.groupBy(*groups, F.col(value))
                .agg(*[m.alias(k) for k, m in measures.items()])
                .withColumn("_slice", slice_of(F.col(value), cuts)))

    unit = groups + ["_slice"]
    before = Window.partitionBy(*unit).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = distinct.select("*", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_loc_{k}") for k in measures])

    # one row per (group, slice), a few hundred a group at most, so these windows stay small
    totals = distinct.groupBy(*unit).agg(*[F.sum(k).alias(f"_tot_{k}") for k in measures])
    low = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(groups or [F.lit(1)]))
    offsets = totals.select(
        *unit,
        *[F.coalesce(F.sum(f"_tot_{k}").over(low), F.lit(0)).alias(f"_off_{k}") for k in measures],
        *[F.sum(f"_tot_{k}").over(whole).alias(names[k][1]) for k in measures],
    )
    joined = _join_keys(local, offsets, unit, "inner")
    return joined.select(
        *groups, value, *measures,
        *[(F.col(f"_off_{k}") + F.col(f"_loc_{k}")).alias(names[k][0]) for k in measures],
        *[names[k][1] for k in measures],
    )


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL group keys match each other."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_value_ranks(df: DataFrame, groups: Sequence[str], value: str, base: DataFrame | None = None) -> DataFrame:
    """Attach ``below``, ``cnt`` and ``n`` to every row; NULL where the value is NULL.

    ``base`` holds the same rows with a shorter lineage, when there is one. A few distinct values are broadcast: a
    shuffle by them would put most rows into few tasks.
    """
    rows = df if base is None else base
    few = rows.select(*groups, value).distinct().limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS
    ranks = value_ranks(rows, groups, value)
    return _join_keys(df, F.broadcast(ranks) if few else ranks, [*groups, value], "left")


def average_percentile() -> Column:
    """Ties share their mean rank; result in (0, 1]."""
    return (F.col("below") + (F.col("cnt") + 1) / 2.0) / F.col("n")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float],
                    ranks: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, one output column per entry of ``probs``."""
    ranks = value_ranks(df, groups, value) if ranks is None else ranks
    v, below, end, n = F.col(value), F.col("below"), F.col("below") + F.col("cnt"), F.col("n")
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (n - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((below <= at) & (at < end), v)).alias(f"{name}_{tag}"))
    agg = ranks.groupBy(*groups).agg(F.max("n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*groups, *out)


def figures(df: DataFrame, quantiles: dict[str, dict[str, float]], sums: dict[str, Column] | None = None, rows: int | None = None,
            accuracy: int = 10_000, gather: int = 2_000, gather_all: int = 40_000) -> dict:
    """All population figures of one level together: exact quantiles ``"<column>_<name>"`` and the aggregates ``sums``.

    ``quantiles`` maps columns to named probabilities. Where an earlier level has counted ``rows`` and they are few,
    the exact ``percentile`` aggregate gives everything in one pass. Otherwise selection by narrowing: the first pass
    counts, takes the sums and sketches two values around each wanted order statistic; the second counts what lies
    below and at them and fetches the values next to them, so the statistic is one of these or strictly inside one
    of the intervals they cut. An interval of at most ``gather`` rows (``gather_all`` over all of them) is fetched.
    Rows are never shuffled. Every pass removes the proposed values themselves, so repeated values cannot stall it,
    and shrinks the interval about ``accuracy``-fold: very large inputs need two or three passes. More than ``WIDE``
    columns would need thousands of aggregates, so their statistics come from ``_selected``.
    """
    cols, sums = list(quantiles), dict(sums or {})
    src = df.withColumns({f"_q{i}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for i, c in enumerate(cols)})
    at_col = {c: f"_q{i}" for i, c in enumerate(cols)}
    wanted = [(c, name, float(p)) for c in cols for name, p in quantiles[c].items()]
    if rows is not None and rows <= EXACT_ROWS:
        row = src.agg(*[F.percentile(v, list(quantiles[c].values())).alias(v) for c, v in at_col.items()],
                      *[a.alias(n) for n, a in sums.items()]).first()
        exact = {f"{c}_{name}": x for c, v in at_col.items() for name, x in zip(quantiles[c], row[v] or [None] * len(quantiles[c]))}
        return {**exact, **{n: row[n] for n in sums}}

    if len(cols) > WIDE:
        known = src.agg(*[a.alias(n) for n, a in sums.items()]).first().asDict() if sums else {}
        plain = df.select(*[F.col(c).cast("double").alias(at_col[c]) for c in cols])  # tasks skip what is unknown
        found, sizes = _selected(plain, [(at_col[c], p) for c, _, p in wanted], gather_all)
        result = {}
        for c, name, p in wanted:
            pos = p * (sizes[at_col[c]] - 1)
            lo, hi = found.get((at_col[c], math.floor(pos))), found.get((at_col[c], math.ceil(pos)))
            result[f"{c}_{name}"] = None if lo is None else lo + (hi - lo) * (pos - math.floor(pos))
        return {**result, **known}

    slack = 2.0 / accuracy
    first = src.agg(
        *[F.count(at_col[c]).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(v, [x for p in quantiles[c].values() for x in (max(0.0, p - slack), min(1.0, p + slack))], accuracy).alias(v)
          for c, v in at_col.items()],
        *[a.alias(n) for n, a in sums.items()]).first()
    result: dict = {f"{c}_{name}": None for c, name, _ in wanted}
    sizes = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    positions = {(c, name): p * (sizes[c] - 1) for c, name, p in wanted if sizes[c]}
    # per order statistic: open interval (lo, hi), rows below it, rows inside it, first proposal
    spans = {}
    for c in cols:
        for i, name in enumerate(quantiles[c] if sizes[c] else ()):
            guess = first[at_col[c]][2 * i:2 * i + 2]
            for k in (math.floor(positions[c, name]), math.ceil(positions[c, name])):
                spans.setdefault(f"{c}|{k}", {"col": at_col[c], "k": k, "lo": None, "hi": None, "below": 0, "m": sizes[c], "guess": guess})
    gather = min(gather, max(100, gather_all // max(1, len(spans))))
    found: dict[str, float] = {}

    def inside(t: dict) -> Column:
        v = F.col(t["col"])
        test = v.isNotNull()
        if t["lo"] is not None:
            test = test & (v > F.lit(t["lo"]))
        if t["hi"] is not None:
            test = test & (v < F.lit(t["hi"]))
        return F.when(test, v)

    while pending := [(key, t) for key, t in spans.items() if key not in found and t["m"] > gather]:
        def around(t: dict) -> list[float]:
            at, slack = (t["k"] - t["below"] + 0.5) / t["m"], 1.0 / accuracy + 1.0 / t["m"]
            return [max(0.0, at - slack), min(1.0, at + slack)]

        open_ = [(key, t) for key, t in pending if t["guess"] is None]
        if open_:
            guess = src.agg(*[F.percentile_approx(inside(t), around(t), accuracy).alias(f"g{i}") for i, (_, t) in enumerate(open_)]).first()
            for i, (_, t) in enumerate(open_):
                t["guess"] = guess[f"g{i}"]
        marks = {(t["col"], g): i for i, (t, g) in enumerate((t, g) for _, t in pending for g in t["guess"])}
        counts = src.agg(*[x.alias(f"{kind}{i}") for (c, g), i in marks.items() for kind, x in (
            ("lt", F.count_if(F.col(c) < F.lit(g))), ("le", F.count_if(F.col(c) <= F.lit(g))),
            ("before", F.max(F.when(F.col(c) < F.lit(g), F.col(c)))), ("after", F.min(F.when(F.col(c) > F.lit(g), F.col(c)))))]).first()
        for key, t in pending:
            edges = [(t["below"], t["lo"])]
            for g in t["guess"]:
                lt, le, before, after = (counts[f"{kind}{marks[t['col'], g]}"] for kind in ("lt", "le", "before", "after"))
                if lt <= t["k"] < le:
                    found[key] = g
                elif t["k"] == lt - 1:
                    found[key] = before
                elif t["k"] == le:
                    found[key] = after
                edges += [(lt, g), (le, g)]
            edges.append((t["below"] + t["m"], t["hi"]))
            if key not in found:
                t["below"], t["lo"] = max((e for e in (edges[0], edges[2], edges[4]) if e[0] <= t["k"]), key=lambda e: e[0])
                end, t["hi"] = min((e for e in (edges[1], edges[3], edges[5]) if e[0] > t["k"]), key=lambda e: e[0])
                t["m"], t["guess"] = end - t["below"], None

    fetch = {key: t for key, t in spans.items() if key not in found}
    if fetch:
        pairs = src.select(F.explode(F.array(*[
            F.struct(F.lit(key).alias("key"), inside(t).alias("v")) for key, t in fetch.items()])).alias("s")).select("s.*")
        at = {key: t["below"] for key, t in fetch.items()}
        some = pairs.filter("v is not null").groupBy("key", "v").count().collect()
        for r in sorted(some, key=lambda r: (r["key"], r["v"])):
            key = r["key"]
            if at[key] <= fetch[key]["k"] < at[key] + r["count"]:
                found[key] = r["v"]
            at[key] += r["count"]
    for (c, name), pos in positions.items():
        lo, hi = found[f"{c}|{math.floor(pos)}"], found[f"{c}|{math.ceil(pos)}"]
        result[f"{c}_{name}"] = lo + (hi - lo) * (pos - math.floor(pos))
    return {**result, **{n: first[n] for n in sums}}


#: bits of a value that one pass of ``_selected`` looks at
DIGIT = 12
LOW_BITS = np.int64(0x7FFFFFFFFFFFFFFF)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; its own inverse on their bits."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ LOW_BITS, bits)


def _range_counts(df: DataFrame, slots: list[tuple[str, int, int]]) -> dict[int, list]:
    """Per slot ``(column, prefix, bits left)`` its ranges by the next digit: ``(digit, rows, least, greatest)``, in order.

    Values count whose bits above the bits left are ``prefix``; the first digit holds sign and exponent. A task holds one
    small table a slot and Spark adds these up, so nothing depends on the number of rows.
    """
    names = list(dict.fromkeys(c for c, _, _ in slots))
    by_column = [[(i, prefix, left) for i, (c, prefix, left) in enumerate(slots) if c == name] for name in names]
    digits = 1 << DIGIT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(slots), digits), np.int64)
        least, most = np.full(n.shape, np.iinfo(np.int64).max), np.full(n.shape, np.iinfo(np.int64).min)
        for batch in batches:
            for column, wanted in enumerate(by_column):
                x = batch.column(column).to_numpy(zero_copy_only=False)
                keys = np.sort(_ordered(x[~np.isnan(x)] + 0.0))
                for i, prefix, left in wanted:
                    if left == 64:
                        part, digit = keys, (keys >> (64 - DIGIT)) + digits // 2
                    else:
                        above = keys >> left
                        part = keys[np.searchsorted(above, prefix):np.searchsorted(above, prefix, "right")]
                        digit = (part >> max(0, left - DIGIT)) & ((1 << min(left, DIGIT)) - 1)
                    if len(part):
                        starts = np.flatnonzero(np.diff(digit, prepend=-1))
                        ends, at = np.append(starts[1:], len(part)), digit[starts]
                        n[i, at] += ends - starts
                        least[i, at] = np.minimum(least[i, at], part[starts])
                        most[i, at] = np.maximum(most[i, at], part[ends - 1])
        i, digit = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(i, pa.int32()), "digit": pa.array(digit, pa.int32()),
                                          "n": n[i, digit], "least": least[i, digit], "most": most[i, digit]})

    parts = df.select(*names).mapInArrow(count, "slot int, digit int, n long, least long, most long")
    rows = parts.groupBy("slot", "digit").agg(F.sum("n"), F.min("least"), F.max("most")).collect()  # 4,096 a slot at most
    out: dict[int, list] = {}
    for slot, *figures in sorted(tuple(r) for r in rows):
        out.setdefault(slot, []).append(figures)
    return out


def _selected(df: DataFrame, wanted: Sequence[tuple[str, float]], gather_all: int) -> tuple[dict[tuple[str, int], float], dict[str, int]]:
    """Order statistics ``(column, position) -> value`` around the wanted ``(column, probability)`` pairs, and column sizes.

    A pass counts rows by the next digit of their values and goes on with the ranges that hold wanted positions: six
    passes at most, whatever the values. A range of one value is done, and so are ranges whose rows are few enough to
    be fetched, which after two or three passes is the rule.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted))
    found: dict[tuple[str, int], float] = {}
    sizes: dict[str, int] = {}
    # a slot with the rows below it, and the positions wanted in it
    open_ = {(c, 0, 64): (0, []) for c in columns}
    while open_:
        slots, rest = list(open_), {}
        counted = _range_counts(df, slots)
        for i, (c, prefix, left) in enumerate(slots):
            below, positions = open_[c, prefix, left]
            if left == 64:
                sizes[c] = sum(r[1] for r in counted.get(i, []))
                ends = [p * (sizes[c] - 1) for a, p in wanted if a == c and sizes[c]]
                positions = sorted({k for pos in ends for k in (math.floor(pos), math.ceil(pos))})
            for digit, rows, least, most in counted.get(i, []):
                inside = [k for k in positions if below <= k < below + rows]
                if inside and least == most:
                    found.update({(c, k): float(_ordered(np.array([least]).view(np.float64)).view(np.float64)[0]) for k in inside})
                elif inside:
                    shift = max(0, left - DIGIT)
                    rest[c, least >> shift, shift] = (below, inside, rows)
                below += rows
        if rest and sum(rows for _, _, rows in rest.values()) <= gather_all:
            found.update(_fetched(df, rest))
            rest = {}
        open_ = {slot: (below, inside) for slot, (below, inside, _) in rest.items()}
    return found, sizes


def _fetched(df: DataFrame, ranges: dict[tuple[str, int, int], tuple[int, list[int], int]]) -> dict[tuple[str, int], float]:
    """The wanted positions of ranges whose rows are few: their values come as they are, counted where they repeat."""
    slots = list(ranges)
    names = list(dict.fromkeys(c for c, _, _ in slots))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (c, prefix, left) in enumerate(slots):
                x = batch.column(names.index(c)).to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)] + 0.0
                some = x[(_ordered(x) >> left) == prefix]
                yield pa.RecordBatch.from_pydict({"slot": pa.array(np.full(len(some), i), pa.int32()), "v": some})

    rows = df.select(*names).mapInArrow(values, "slot int, v double").groupBy("slot", "v").count().collect()
    at = [ranges[s][0] for s in slots]
    found = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["v"])):
        i = r["slot"]
        found.update({(slots[i][0], k): r["v"] for k in ranges[slots[i]][1] if at[i] <= k < at[i] + r["count"]})
        at[i] += r["count"]
    return found


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float], accuracy: int = 10_000,
                     gather: int = 2_000, rows: int | None = None) -> dict[str, float | None]:
    """Exact quantiles of whole columns, as ``{"<column>_<name>": value}``; see ``figures``."""
    return figures(df, {c: probs for c in dict.fromkeys(columns)}, rows=rows, accuracy=accuracy, gather=gather)


def per_column(df: DataFrame, columns: Sequence[str], figures, chunk: int = 24) -> DataFrame:
    """One row ``(column, <figures>)`` per column; ``figures(c)`` maps names to aggregates.

    Columns are aggregated in chunks: a columnar source still reads every column once,
    while one aggregate over hundreds of columns would outgrow code generation.
    """
    out = None
    for i in range(0, len(columns), chunk):
        part = columns[i:i + chunk]
        wide = df.agg(*[F.struct(*[a.alias(n) for n, a in figures(c).items()]).alias(c) for c in part])
        rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("f")) for c in part])).alias("s")) \
            .select("s.column", "s.f.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def small_side(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``limit`` rows.

    At most ``limit + 1`` rows reach the driver. A larger table is returned as it
    is, and the join falls to a shuffle with adaptive skew handling.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach_group(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join per-group figures to rows; clashing columns on the row side are replaced."""
    clash = [c for c in stats.columns if c not in keys and c in df.columns]
    return df.drop(*clash).join(small_side(stats), list(keys), "left")


def ordered_positions(df: DataFrame, order: Sequence[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """Global ``position`` (from 1) under a total order, with optional running sums.

    Range-sorts once, stages the sorted rows with their partition and offset, and
    shifts each partition by the sizes of the earlier ones (one row per partition).
    """
    sums = sums or {}
    staged = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    staged = staged.withColumn("_pid", F.shiftright("_mid", 33))
    # a range partition is one sorted slice of the data, so this window is balanced
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", F.row_number().over(Window.partitionBy("_pid").orderBy("_mid")).cast("long").alias("_pos"),
                          *[F.sum(c).over(within).alias(f"_run_{k}") for k, c in sums.items()])
    sizes = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_tot_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(F.lit(1)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                           *[F.coalesce(F.sum(f"_tot_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}") for k in sums],
                           *[F.sum(f"_tot_{k}").over(whole).alias(f"{k}_total") for k in sums])
    joined = local.join(small_side(offsets), "_pid")
    return joined.select(
        *df.columns, (F.col("_off") + F.col("_pos")).alias("position"),
        *[(F.col(f"_off_{k}") + F.col(f"_run_{k}")).alias(f"{k}_running") for k in sums],
        *[f"{k}_total" for k in sums])
