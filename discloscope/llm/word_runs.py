"""Periodic runs of words as maximal pairs of an LCP-interval tree.

In the suffix array of a text's words, an LCP interval of depth l holds the places at which one sequence of l words
stands. Two places from different children of it agree for exactly l words; if the words left of them differ, too, they
are a maximal pair. Such a pair at a distance p with l >= (e - 1) * p is a run of period p and l + p words: left and
right ends are those of the pair, and nothing has to be extended.

Intervals are closed bottom-up. Each holds its places in text order, each place in the class of its left word. Two
places of one interval at a distance of l / 2 or less differ by a multiple of the period of the interval's words, so the
pair that shows a run's smallest period stands side by side in that list: a place that joins is paired with the
nearest ones before and after it, if they are of another class. The smaller list joins the larger one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from discloscope.llm.common import without

#: bytes of text whose words share one suffix array
PORTION = 1 << 21


def suffix_ranks(codes: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of which ``least`` words or more stand elsewhere too, as in the suffix array, and ranks of 1, 2, 4, ... words.

    Equal ranks of a level are equal words. Ranks double; after the first levels only places that are not alone so
    far are ranked again.
    """
    n = len(codes)
    ranks, open_, width, levels = codes.astype(np.int32), np.arange(n), 1, []
    placed = open_
    while True:
        levels.append(ranks)
        if width == 1 << (least.bit_length() - 1):  # what is alone by now has no interval of this depth
            placed = open_
        if not len(open_):
            break
        ahead = open_ + width
        behind = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((behind, ranks[open_]))
        first, second = ranks[open_][order], behind[order]
        old = np.concatenate(([True], first[1:] != first[:-1]))
        starts = np.flatnonzero(old | np.concatenate(([True], second[1:] != second[:-1])))
        sizes = np.diff(np.append(starts, len(order)))
        # a new rank is the old one and the number of smaller places of that old rank
        since = np.maximum.accumulate(np.where(old, np.arange(len(order)), 0))[starts]
        ranks = ranks.copy()
        ranks[open_[order]] = np.repeat(first[starts] + starts - since, sizes)
        open_, width = open_[order][np.repeat(sizes > 1, sizes)], width * 2
    placed = placed if width >= 1 << (least.bit_length() - 1) else open_
    return placed[np.argsort(ranks[placed])], levels


def common_words(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words agree from two places on, from the largest level down."""
    n = len(levels[0])
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total
        same = (x < n) & (y < n)
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        total[same] += 1 << k
    return total


def maximal_pairs(places: list[int], depths: list[int], left: list[int], exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs among neighbouring places of the LCP-interval tree over ``places``.

    ``depths[i]`` is what place i agrees in with the one before it; ``left`` has the class of each place. A run may
    come with multiples of its period as well.
    """
    runs: list[tuple[int, int, int]] = []

    def joined(depth: int, one: list[int], two: list[int]) -> list[int]:
        small, large = (one, two) if len(one) < len(two) else (two, one)
        most, end = depth // (exponent - 1), len(large)
        spots = [bisect_left(large, x) for x in small]
        for x, spot in zip(small, spots):
            if spot and x - large[spot - 1] <= most and left[x] != left[large[spot - 1]]:
                runs.append((large[spot - 1], depth, x - large[spot - 1]))
            if spot < end and large[spot] - x <= most and left[x] != left[large[spot]]:
                runs.append((x, depth, large[spot] - x))
        if len(small) * 8 > len(large):
            return sorted(large + small)
        for x, spot in zip(reversed(small), reversed(spots)):
            large.insert(spot, x)
        return large

    stack: list[tuple[int, list[int]]] = []  # open intervals and their places in text order
    for place, depth in zip(places, [*depths[1:], 0]):  # a place and what it agrees in with the next one
        held = [place]
        while stack and stack[-1][0] >= max(1, depth):
            held = joined(*stack.pop(), held)
            # an interval of just this depth stays open for the next place
        if depth:
            stack.append((depth, held))
    return [(start, depth + period, period) for start, depth, period in runs if depth + period >= shortest]


def runs_of(texts: list[list[bytes]], exponent: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every text (lists of words) as start, length and smallest period, in order of start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    if not bounds[-1]:
        return out
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, bounds[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # words of different texts are different words, so no pair reaches over a border
    keys = owner * len(known) + words
    order = np.argsort(keys, kind="stable")
    fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    codes = np.empty(len(keys), np.int64)
    codes[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # as a rank: the number of smaller places
    # a run of this length and exponent agrees with itself in so many words at least
    least = min(max(shortest - p, (exponent - 1) * p) for p in range(1, max(1, shortest) + 1))
    places, levels = suffix_ranks(codes, least)
    if not len(places):
        return out
    depths = np.concatenate(([0], common_words(places[:-1], places[1:], levels)))
    depths[depths < least] = 0
    left = np.concatenate(([-1], codes[:-1]))
    found: dict[tuple[int, int], int] = {}
    for start, length, period in maximal_pairs(places.tolist(), depths.tolist(), left.tolist(), exponent, shortest):
        found[start, length] = min(period, found.get((start, length), period))
    for (start, length), period in sorted(found.items(), key=lambda r: (r[0][0], r[1])):
        out[owner[start]].append((int(start - bounds[owner[start]]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def word_runs(docs: DataFrame, column: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """All rows with all columns but ``column``, ``n_words``, ``runs`` (structs of start, length and period, by start and
    period) and ``collapsed``, the words without what repeats.

    Words are maximal runs of characters other than ASCII white space, numbered from 0. A run is a stretch with
    smallest period p, of at least ``shortest`` words and ``exponent`` (2 or more) times p, that no neighbouring word
    extends. A word goes if any run holds it after that run's first p words.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows are looked at one by one, repeated
    ones included; an empty table gives no rows; input columns of the new names give way. A task's memory depends on
    the longest text.
    """
    if exponent < 2:
        raise ValueError("the exponent must be 2 at least")
    kept = without(docs, column, "n_words", "runs", "collapsed", "_text")
    given = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{column}`").cast("string").alias("_text"))
    added = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def portions(column: pa.Array) -> Iterator[list[bytes]]:
        texts, size = [], 0
        for text in column.cast(pa.large_binary()):
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= PORTION:
                yield texts
                texts, size = [], 0
        if texts:
            yield texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in portions(batch.column("_text")):
                words = [t.split() for t in texts]  # of bytes: at ASCII white space only
                runs = runs_of(words, exponent, shortest)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(map(len, words), pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], runs_type),
                     pa.array([collapsed(w, r).decode("utf-8") for w, r in zip(words, runs)], pa.string())],
                    names=[*part.schema.names[:-1], "n_words", "runs", "collapsed"])

    return given.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(added).fields]))
