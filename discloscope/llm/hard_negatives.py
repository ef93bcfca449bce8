"""Hard negatives by score bounds along a spanning tree of the anchors.

Anchors fall into blocks of bounded size; a block's minimum spanning tree links each anchor to one near it. What an
anchor ``a`` scores with a candidate ``x`` lies within ``|a - parent| * |x|`` of what its parent scores, so a walk from
the root hands every anchor an interval for every candidate. Only candidates whose interval overlaps a window that
matters are scored; their intervals shrink to the score, and the walk goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloscope.llm.topk import usable
from discloscope.session import materialize

#: whole numbers up to here are exact as doubles
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: float = 256.0, block: int = 1024, tile: int = 4096, fan_in: int = 64) -> DataFrame:
    """Per anchor and positive the best ``negatives`` rows of other labels inside the window of the positive:
    ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``.

    Both inputs have ``vec_id``, ``embedding`` and ``label``. Components become floor(scale * x); a score is the inner
    product. Higher scores come first, ties go to the smaller id. An anchor's positives are its best ``positives`` other
    rows of its label; a negative scores ``low`` to ``high`` hundredths of its positive.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; only vectors of equal
    length meet. Repeated rows count once, an id counts once a score, and rows with an anchor's own id are neither its
    positives nor its negatives. A repeated anchor id is asked once, with its smallest label and vector. Scores outside
    the range of a long are held at its ends. Empty inputs give no rows; other columns are ignored.
    """
    whole = [df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
             .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))) for df in (anchors, rows)]
    asked = whole[0].groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("vec_id", "a.label", "a.embedding")
    # repeated rows go before they are shuffled
    told = whole[1].groupBy("vec_id", "label", "embedding").agg(F.count(F.lit(1)).alias("_times")).drop("_times")
    n_blocks, n_tiles = [max(1, -(-df.count() // size)) for df, size in ((whole[0], block), (whole[1], tile))]
    trees = asked.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"), "vec_id", "label", "embedding")
    trees = materialize(trees.groupBy("dim", "block").applyInArrow(
        _spanning_tree(scale), "dim int, block long, node int, parent int, edge double, anchor_id long, label long, embedding array<double>"))
    tiles = told.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(n_tiles)).alias("c_tile"), "vec_id", "label", "embedding")
    tiles = tiles.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    each_tile = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long")))
    keys = ["dim", "block", "c_tile"]

    found = trees.withColumn("c_tile", each_tile).groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(
        _positives_in_tile(positives, scale), "anchor_id long, c_tile long, score long, vec_id long")
    best = materialize(_best(found, ["anchor_id"], n_tiles, positives, fan_in))

    windows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("windows"))
    opened = trees.join(windows, "anchor_id", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<struct<rank:int,vec_id:bigint,score:bigint>>")))
    found = opened.withColumn("c_tile", each_tile).groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(
        _negatives_in_tile(negatives, low, high, scale),
        "anchor_id long, positive_id long, positive_score long, c_tile long, score long, vec_id long")
    kept = _best(found, ["anchor_id", "positive_id", "positive_score"], n_tiles, negatives, fan_in)
    return kept.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _best(found: DataFrame, keys: list[str], tiles: int, k: int, fan_in: int) -> DataFrame:
    """The ``k`` best of each key: tiles merge ``fan_in`` at a time, so a group never holds more than ``k * fan_in`` rows."""
    hit = F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "vec_id", "score").alias("hit")
    listed = found.select(*keys, "c_tile", hit)
    while True:
        tiles = -(-tiles // fan_in)
        listed = listed.withColumn("c_tile", F.floor(F.col("c_tile") / fan_in)).groupBy(*keys, "c_tile").agg(
            F.slice(F.sort_array(F.array_distinct(F.collect_list("hit"))), 1, k).alias("hits"))
        if tiles <= 1:
            break
        listed = listed.select(*keys, "c_tile", F.explode("hits").alias("hit"))
    return listed.select(*keys, F.posexplode("hits").alias("pos", "hit")).select(
        *keys, (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _matrix(t: pa.Table, scale: float) -> np.ndarray:
    column = t["embedding"].combine_chunks()
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).reshape(t.num_rows, -1)


def _spanning_tree(scale: float):
    """Per block its anchors in an order that puts parents first: node, parent (-1 at the root) and edge length."""
    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        with np.errstate(over="ignore", invalid="ignore"):
            x, n = _matrix(t, scale), t.num_rows
            middle = np.nan_to_num(((x - x.mean(axis=0)) ** 2).sum(axis=1), nan=np.inf)
            root = int(middle.argmin())
            near, link, free = np.full(n, np.inf), np.full(n, root), np.ones(n, bool)
            below: list[list[int]] = [[] for _ in range(n)]
            new, free[root] = root, False
            for _ in range(n - 1):
                away = np.nan_to_num(((x - x[new]) ** 2).sum(axis=1), nan=np.inf)
                closer = free & (away < near)
                near[closer], link[closer] = away[closer], new
                rest = np.flatnonzero(free)
                new = int(rest[near[rest].argmin()])
                free[new] = False
                below[link[new]].append(new)
            # depth first, so that a walk holds the bounds of one path only
            order, parent, edge, stack = [], [], [], [(root, -1)]
            while stack:
                at, up = stack.pop()
                stack += [(c, len(order)) for c in reversed(below[at])]
                order.append(at)
                parent.append(up)
                edge.append(0.0 if up < 0 else float(np.sqrt(near[at])))
        t = t.take(pa.array(order))
        return pa.table([t["dim"], t["block"], pa.array(range(n), pa.int32()), pa.array(parent, pa.int32()), pa.array(edge), t["vec_id"], t["label"], t["embedding"]],
                        names=["dim", "block", "node", "parent", "edge", "anchor_id", "label", "embedding"])
    return grow


class _Walk:
    """Goes through a block's tree for one tile: intervals of all candidates, exact where they were scored."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, scale: float, factor: int):
        self.anchors, by_id = anchors.sort_by("node"), candidates.sort_by("vec_id")
        self.a, self.c = _matrix(self.anchors, scale), _matrix(by_id, scale)
        self.ids, self.labels = by_id["vec_id"].to_numpy(), by_id["label"].to_numpy()
        self.anchor_ids, self.anchor_labels = self.anchors["anchor_id"].to_pylist(), self.anchors["label"].to_pylist()
        # whether all scores, multiplied by a factor for comparisons, are whole numbers that doubles hold
        self.plain = self.a.shape[1] == 0 or np.abs(self.a).max() * np.abs(self.c).max() * self.a.shape[1] * factor < _EXACT
        self.parents = self.anchors["parent"].to_pylist()
        self.norms = np.sqrt((self.c ** 2).sum(axis=1)) if self.plain else None

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Node by node the bounds below and above; ``score`` may be called with them."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left = [0] * len(self.a)
        for parent in self.parents[1:]:
            left[parent] += 1
        for node, (parent, edge) in enumerate(zip(self.parents, self.anchors["edge"].to_pylist())):
            if not self.plain:
                lo, hi = np.full(len(self.c), -np.inf), np.full(len(self.c), np.inf)
            elif parent < 0:
                lo = self.c @ self.a[node]
                hi = lo.copy()
            else:
                wide = edge * self.norms * (1 + 1e-9) + 1e-3  # more than rounding can take away
                lo, hi = held[parent][0] - wide, held[parent][1] + wide
                left[parent] -= 1
                if not left[parent]:
                    del held[parent]
            yield node, lo, hi
            if left[node]:
                held[node] = lo, hi

    def score(self, node: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores the wanted candidates and narrows their bounds; their places in order of id."""
        if self.plain:
            if 2 * np.count_nonzero(wanted) > len(wanted):
                lo[:] = hi[:] = self.c @ self.a[node]
                return np.flatnonzero(wanted)
            at = np.flatnonzero(wanted)
            lo[at] = hi[at] = self.c[at] @ self.a[node]
        else:
            at = np.flatnonzero(wanted)
        return at

    def values(self, node: int, lo: np.ndarray, at: np.ndarray):
        """Scores of places that were scored: doubles, or whole numbers held within the range of a long."""
        if self.plain:
            return lo[at]
        a = [int(x) for x in self.a[node]]
        return np.array([_clip(sum(int(x) * y for x, y in zip(self.c[i], a))) for i in at], dtype=object)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` highest scores, ties by id, each id once a score; ``ids`` ascend."""
    if len(scores) > 4 * k and scores.dtype != object:
        floor = np.unique(scores)
        floor = floor[max(0, len(floor) - k)]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    out: list[int] = []
    for i in at[np.argsort(-scores[at], kind="stable")] if len(at) else ():
        if not out or ids[i] != ids[out[-1]] or scores[i] != scores[out[-1]]:
            out.append(int(i))
            if len(out) == k:
                break
    return out


def _clip(x) -> int:
    return max(_LONG[0], min(_LONG[1], int(x)))


def _positives_in_tile(k: int, scale: float):
    names = ["anchor_id", "c_tile", "score", "vec_id"]

    def pair(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            walk, tile = _Walk(anchors, candidates, scale, 1), candidates["c_tile"][0].as_py()
            for node, lo, hi in walk:
                wanted = (walk.labels == walk.anchor_labels[node]) & (walk.ids != walk.anchor_ids[node])
                sure = np.unique(walk.ids[wanted]).size
                if sure > k and walk.plain:  # at least k ids score this much
                    below = lo[wanted]
                    each = np.maximum.reduceat(below, np.flatnonzero(np.diff(walk.ids[wanted], prepend=walk.ids[wanted][0] - 1)))
                    wanted &= hi >= np.partition(each, len(each) - k)[len(each) - k]
                at = walk.score(node, lo, hi, wanted)
                scores = walk.values(node, lo, at)
                out += [(walk.anchor_ids[node], tile, int(scores[i]), int(walk.ids[at[i]])) for i in _first(walk.ids[at], scores, k)]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=names)
    return pair


def _negatives_in_tile(k: int, low: int, high: int, scale: float):
    names = ["anchor_id", "positive_id", "positive_score", "c_tile", "score", "vec_id"]

    def pair(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            walk, tile = _Walk(anchors, candidates, scale, max(100, low, high)), candidates["c_tile"][0].as_py()
            listed = walk.anchors["windows"].to_pylist()
            for node, lo, hi in walk:
                windows = [(w["vec_id"], w["score"]) for w in listed[node] if low * w["score"] <= high * w["score"]]
                other = walk.labels != walk.anchor_labels[node]
                other &= walk.ids != walk.anchor_ids[node]
                meets = np.zeros(len(other), bool)
                for _, score in windows:
                    meets |= (100 * hi >= low * score) & (100 * lo <= high * score)
                at = walk.score(node, lo, hi, other & meets)
                scores = walk.values(node, lo, at)
                for positive, score in windows:
                    inside = np.flatnonzero((100 * scores >= low * score) & (100 * scores <= high * score)) if len(at) else at
                    out += [(walk.anchor_ids[node], positive, score, tile, int(scores[i]), int(walk.ids[at[i]]))
                            for i in inside[_first(walk.ids[at[inside]], scores[inside], k)]]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6)], names=names)
    return pair
