"""Exact top-k search by inner product: tiles, partial selection, tree merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, query_tile: int = 8192,
                candidate_tile: int = 2048, fan_in: int = 64) -> DataFrame:
    """Per query the ``k`` highest integer inner products: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Both inputs have ``vec_id`` and ``embedding``. Components become floor(scale * x). Queries and candidates are
    hashed into tiles of bounded size; each pair of tiles is one matrix product that keeps k rows a query, and the
    lists merge level by level, ``fan_in`` tiles at a time. Products are taken in doubles while every sum is below
    2^53, else in whole numbers of any length; a score outside the range of a long is held at its end.

    A candidate with the query's own id is left out, ties go to the smaller id, repeated candidate rows each take
    part, a repeated query id is asked once (with its smallest vector). Rows with a null id, or a vector that is
    null or holds null or non-finite components, take no part; only vectors of equal length meet. No queries or no
    candidates give no rows. Other columns are ignored.
    """
    both = [df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for df in (queries, candidates)]
    asked = both[0].groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_q, n_c = [max(1, -(-df.count() // size)) for df, size in ((both[0], query_tile), (both[1], candidate_tile))]
    dim = F.size("embedding").alias("dim")
    left = asked.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).alias("q_tile"), "vec_id", "embedding")
    left = left.withColumn("c_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    right = both[1].select(dim, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_c)).alias("c_tile"), "vec_id", "embedding")
    right = right.withColumn("q_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    keys = ["dim", "q_tile", "c_tile"]
    order = "q_tile long, c_tile long, query_id long, score long, vec_id long"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile_product(k, scale), order)

    tile, n = F.col("c_tile"), n_c
    listed = found.select("q_tile", "query_id", tile, F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "vec_id", "score").alias("hit"))
    while True:
        n = -(-n // fan_in)
        listed = (listed.withColumn("c_tile", F.floor(F.col("c_tile") / fan_in)).groupBy("query_id", "c_tile")
                  .agg(F.slice(F.sort_array(F.collect_list("hit")), 1, k).alias("hits")))
        if n <= 1:
            break
        listed = listed.select("query_id", "c_tile", F.explode("hits").alias("hit"))
    return listed.select("query_id", F.posexplode("hits").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _tile_product(k: int, scale: float, rows: int = 256):
    def matrix(t: pa.Table) -> np.ndarray:
        column = t["embedding"].combine_chunks()
        return np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).reshape(t.num_rows, -1)

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        whole = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
        return np.clip(whole, -(1 << 63), (1 << 63) - 1)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["q_tile", "c_tile", "query_id", "score", "vec_id"], pa.int64()
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            q_ids, c_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            by_id = np.argsort(c_ids, kind="stable")  # so a stable sort by score leaves the smaller id first
            c_ids, c, q = c_ids[by_id], matrix(right)[by_id], matrix(left)
            plain = q.shape[1] == 0 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT
            for at in range(0, len(q), rows):
                block = q[at:at + rows]
                scores = (block @ c.T) if plain else exact(block, c)
                for i, row in enumerate(scores):
                    own = q_ids[at + i]
                    left_in = np.flatnonzero(c_ids != own)
                    row = row[left_in]
                    if len(row) > k and plain:
                        edge = np.partition(row, len(row) - k)[len(row) - k]
                        at_least = np.flatnonzero(row >= edge)
                        left_in, row = left_in[at_least], row[at_least]
                    best = np.argsort(-row, kind="stable")[:k]
                    out[2] += [int(own)] * len(best)
                    out[3] += [int(x) for x in row[best]]
                    out[4] += [int(x) for x in c_ids[left_in[best]]]
            out[0], out[1] = [left["q_tile"][0].as_py()] * len(out[2]), [left["c_tile"][0].as_py()] * len(out[2])
        return pa.table([pa.array(x, types) for x in out], names=names)
    return pair
