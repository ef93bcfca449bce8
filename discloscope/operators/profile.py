"""One sweep over a wide table: what every column holds, fingerprints of columns, and how columns go together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a batch that are multiplied at a time
ROWS = 4096


@dataclass(frozen=True)
class Profile:
    """Figures by column, and by pair of columns over the rows that know both; their sizes depend on the columns only.

    ``columns`` has count, null_count, mean, std (of a sample), min, max and print; ``r`` the correlations.
    """

    columns: pd.DataFrame
    r: pd.DataFrame

    def constant(self) -> list[str]:
        """Columns with one known value at most."""
        return [c for c, f in self.columns.iterrows() if f["count"] == 0 or f["min"] == f["max"]]

    def alike(self, among: Sequence[str]) -> list[tuple[str, str]]:
        """Pairs of equal fingerprint, the earlier column first; values decide in the end."""
        groups: dict[int, list[str]] = {}
        for c in among:
            groups.setdefault(int(self.columns.at[c, "print"]), []).append(c)
        return [(g[i], g[j]) for g in groups.values() for i in range(len(g)) for j in range(i + 1, len(g))]

    def correlated(self, among: Sequence[str], above: float) -> list[tuple[str, str, float]]:
        return [(a, b, float(self.r.at[a, b])) for i, a in enumerate(among) for b in among[i + 1:] if abs(self.r.at[a, b]) > above]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_profile(df: DataFrame, row_id: str, columns: Sequence[str]) -> Profile:
    """Profile of numeric ``columns``; NULL and NaN count as unknown, ``row_id`` tells rows apart.

    Every task sums up its rows into one small table that adds up with those of the others: counts, extremes, sums and
    products of values less a first one (so that large means cost no digits), and an order-free fingerprint.
    """
    names = list(columns)
    wide = df.select(F.xxhash64(row_id).alias("_id"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(names)])
    first = wide.select(*[f"c{i}" for i in range(len(names))]).first()
    shift = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in (first or [0.0] * len(names))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))  # over the rows that know both: count, sum and squares of the first, products
        low, high, marks = np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.uint64)
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows += part.num_rows
                x = np.column_stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
                known = ~np.isnan(x)
                low, high = np.fmin(low, np.where(known, x, np.inf).min(axis=0)), np.fmax(high, np.where(known, x, -np.inf).max(axis=0))
                ids = part.column(0).to_numpy().view(np.uint64)
                bits = np.where(known, x + 0.0, 0.0).view(np.uint64) ^ np.where(known, np.uint64(0), np.uint64(0x9E3779B97F4A7C15))
                marks ^= np.bitwise_xor.reduce(_mixed(_mixed(bits) + ids[:, None]), axis=0)
                d = np.where(known, x - shift, 0.0)
                p += d.T @ d
                if known.all():  # sums by column then hold for all pairs
                    n += len(x)
                    s += d.sum(axis=0)[:, None]
                    q += (d * d).sum(axis=0)[:, None]
                else:
                    m = known.astype(float)
                    n, s, q = n + m.T @ m, s + d.T @ m, q + (d * d).T @ m
        if rows:
            i, j = (a.ravel() for a in np.meshgrid(range(k), range(k), indexing="ij"))
            own = i == j
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": n.ravel(), "s": s.ravel(), "q": q.ravel(), "p": p.ravel(), "rows": pa.array(np.where(own, rows, 0), pa.int64()),
                "low": np.where(own, low[i], np.inf), "high": np.where(own, high[i], -np.inf), "mark": np.where(own, marks[i], np.uint64(0)).view(np.int64)})

    parts = wide.mapInArrow(sums, "i int, j int, n double, s double, q double, p double, rows long, low double, high double, mark long")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p", "rows")], F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("mark").alias("mark"))
    k = len(names)
    found = total.toPandas().sort_values(["i", "j"])  # one row a pair of columns
    if found.empty:
        empty = pd.DataFrame({"count": 0, "null_count": 0, "mean": np.nan, "std": np.nan, "min": np.nan, "max": np.nan, "print": 0}, index=names)
        return Profile(empty, pd.DataFrame(np.full((k, k), np.nan), names, names))
    n, s, q, p = (found[c].to_numpy().reshape(k, k) for c in ("n", "s", "q", "p"))
    own = found[found["i"] == found["j"]]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, var = p - s * s.T / n, q - s * s / n
        r = cov / np.sqrt(var * var.T)
        count = np.diag(n)
        figures = pd.DataFrame({
            "count": count.astype(int), "null_count": own["rows"].to_numpy() - count.astype(int), "mean": shift + np.diag(s) / count,
            "std": np.sqrt(np.maximum(np.diag(cov), 0.0) / (count - 1)), "min": own["low"].to_numpy(), "max": own["high"].to_numpy(), "print": own["mark"].to_numpy()}, index=names)
    return Profile(figures, pd.DataFrame(r, names, names))
