"""Exact Jaccard self-join of word-shingle sets by pivots, triangle-inequality windows and recursion.

Jaccard distance on five-word shingles is nearly discrete: almost every pair of texts is at distance 1, so a plain
Voronoi diagram of a few pivot documents has one border that holds the whole corpus. Regions are therefore seeded by
shared rare elements: two sets at distance 0.2 or less share an element among the first fifth of either set, in any
common order. Each element is a region; its smallest class is the pivot, and distances to the pivot give

* the ball (distance at most t): linked to the pivot, so members need no comparison among themselves;
* the border (at most 2 t): replicated into comparisons with the ball, as the triangle inequality demands;
* the rest (beyond 2 t): cannot link with the ball and is joined on its own.

Large regions are first cut by set size, as linked sets are of similar size. Regions that already lie in one component are done. The smallest ones and blocks of middling ones are joined inside the windows. Members of large ones
recur as a corpus of their own, in an order that puts the elements that many of them hold last, which takes shared passages
out of play.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import portions, row_key
from discloscope.llm.components import connected_components
from discloscope.llm.shingles import lists, parity, shingle_sets
from discloscope.session import materialize

#: members beyond which a region is cut by set size, and beyond which an element counts as frequent
SMALL_REGION = 48
#: members up to which the rows of a region are joined; beyond, its blocks are, where a sketch goes once to a region, not to every pair
PAIRED_REGION = 8
#: times that large regions recur; what is then left is joined in blocks
LEVELS = 2
#: members of a region that meet in one task; larger regions recur
BLOCK = 1000
#: comparisons for which large regions do not recur
FEW_COMPARISONS = 200_000_000
#: bits of a sketch up to which a forest takes it whole
BLOCK_CELLS = 512
#: for distances, which are quotients; links are decided in whole numbers
SLACK = 1e-9
#: ids or elements up to which a filter is broadcast (8 bytes each)
BROADCAST_IDS = 500_000
#: pairs up to which they are broadcast (32 bytes each)
BROADCAST_PAIRS = 100_000


class Measure:
    """Jaccard similarity of at least ``percent`` hundredths, in whole numbers."""

    def __init__(self, percent: int):
        if not 50 < percent < 100:
            raise ValueError("the similarity must lie between 51 and 99 hundredths")
        self.percent, self.twice = percent, max(1, 2 * percent - 100)

    def possible(self, n: Column, m: Column, differ: Column, percent: int) -> Column:
        """Whether sets of these sizes that differ in at least so many elements may reach ``percent``."""
        sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
        return sizes & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _folded(x: Column) -> Column:
    """A sketch of half the cells."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda i, j: i.bitwiseXOR(j))


def _halved(x: Column) -> Column:
    return F.when(F.size(x) * 64 > BLOCK_CELLS, _folded(x)).otherwise(x)


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the length of the other."""
    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, i: s + i)

    # sizes within reach of each other have sketches of equal length or of twice the length
    return F.when(F.size(a) == F.size(b), bits(a, b)).when(F.size(a) > F.size(b), bits(_folded(a), b)).otherwise(bits(a, _folded(b)))


def fingerprint(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id``, ``row_key``, ``n`` (set size), ``cls`` (fingerprint of the set), ``sketch`` and ``prefix`` (its first elements)."""
    def build(batches):
        sets = shingle_sets(words)
        for batch in (part for whole in batches for part in portions(whole, "text")):
            ids, sizes, classes, sketches, prefixes = batch.column("doc_id"), [], [], [], []
            for s in sets(batch.column("text")):
                n = len(s)
                sizes.append(n)
                classes.append(fingerprint(s) if n else None)
                sketches.append(parity(s) if n else s)
                prefixes.append(s[:n - -(-n * percent // 100) + 1].copy())  # not a view, which would keep the whole set
            yield pa.RecordBatch.from_arrays([ids, batch.column("row_key"), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), lists(sketches), lists(prefixes)],
                                             names=["doc_id", "row_key", "n", "cls", "sketch", "prefix"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").mapInArrow(
        build, "doc_id long, row_key long, n int, cls long, sketch array<long>, prefix array<long>")


def _of_classes(docs: DataFrame, classes: DataFrame, wanted: DataFrame, at_most: int, words: int, part=None) -> DataFrame:
    """``cls`` and ``items`` (all shingles, or what ``part`` takes of them) of the wanted classes, from one text each.

    There are ``at_most`` so many of them; that decides whether their ids are broadcast.
    """
    few = at_most <= BROADCAST_IDS
    ids = classes.join(F.broadcast(wanted.select("cls")) if few else wanted.select("cls").distinct(), "cls", "left_semi").select("cls", "rep")
    keep = F.broadcast(ids) if few else ids

    def build(batches):
        sets = shingle_sets(words)
        for batch in (part for whole in batches for part in portions(whole, "text")):
            found = list(sets(batch.column("text")))
            # an id that several texts share also brings texts of other classes
            own = [i for i, cls in enumerate(batch.column("cls").to_pylist()) if fingerprint(found[i]) == cls]
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(own, pa.int64())), lists([part(found[i]) if part else found[i] for i in own])], names=["cls", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(keep, "rep").select("cls", "text")
    return texts.mapInArrow(build, "cls long, items array<long>")


def _regions(prefixes: DataFrame, own: DataFrame | None) -> DataFrame:
    """Members of every element that two classes or more hold in their prefix: ``token``, ``cls``, ``pivot``.

    The pivot is the member with the fewest elements of its own, which is the most central one. Most elements are held
    by one class alone; only those that are shared meet their members again. Near copies share many elements, so of all
    elements with the same members one is enough: members are told by the smallest, the largest, the XOR and a sum of
    their fingerprints, which repeated rows of a class do not blur, as they bring every element of it equally often.
    """
    held = prefixes.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.bit_xor("cls").alias("mix"),
                                         F.sum(F.col("cls").bitwiseAND(F.lit(0xFFFFFFFF))).alias("total")).filter("lo <> hi")
    shared = materialize(held.groupBy("lo", "hi", "mix", "total").agg(F.min("token").alias("token")).select("token", F.col("lo").alias("pivot")))
    few = F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared
    members = prefixes.join(few, "token").select("token", "cls", "pivot").distinct()
    if own is None:
        return members
    members = materialize(members.drop("pivot"))
    pivots = members.join(own, "cls", "left").groupBy("token").agg(F.min_by("cls", F.struct(F.coalesce("own", F.lit(0)), "cls")).alias("pivot"))
    return members.join(pivots, "token")


def _by_size(regions: DataFrame, classes: DataFrame, own: DataFrame | None, small: int, percent: int) -> DataFrame:
    """Large regions cut by set size: linked sets are of one or of neighbouring size cells, so each member goes to its
    own cell and the next one, and two that may link meet in one of them."""
    large = materialize(regions.groupBy("token").agg(F.count(F.lit(1)).alias("_members")).filter(F.col("_members") > small).select("token"))
    n = large.count()
    if n == 0:
        return regions
    large = F.broadcast(large) if n <= BROADCAST_IDS else large
    # cells are a little wider than sizes within reach of each other, so rounding cannot part them
    cell = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent))
    cells = regions.join(large, "token").join(classes.select("cls", "n"), "cls").select("token", "cls", F.explode(F.array(cell, cell + 1)).alias("_cell"))
    cut = _regions(materialize(cells.select(F.xxhash64("token", "_cell").alias("token"), "cls")), own)
    return materialize(regions.join(large, "token", "left_anti").unionByName(cut))


def _with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds sizes and sketches of ``a`` and ``b``."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs


def _measured(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """``a``, ``b`` and the shared elements of each pair, counted exactly; ``few`` pairs are broadcast."""
    asked = pairs.select("a", "b", "n_a", "n_b")
    one = (F.broadcast(asked) if few else asked).join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b")
    return two.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).alias("common"))


def _distance(common: Column, n: Column, m: Column) -> Column:
    return 1 - common / (n + m - common)


def _label(df: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(column))
    named = labels.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return df.join(named, column, "left").withColumn(name, F.coalesce("_c", F.col(column))).drop("_c")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, small: int = SMALL_REGION) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, and ``row_key``, which tells rows of one id apart.

    Documents are linked when the Jaccard similarity of their sets of distinct ``words``-word shingles reaches
    ``percent`` hundredths. ``component_id`` is the smallest ``doc_id`` reachable by links, itself included. Shingles
    are 64-bit hashes and equal sets share a 64-bit fingerprint; apart from hash collisions the join is exact.

    Texts without words (null, empty, blank) have no shingles and stand alone. Repeated rows and ids that several
    rows share are rows of their own. A row with a null id has the component of an equal set, or null. Extra
    columns are not read. An empty table gives no rows.
    """
    measure = Measure(percent)
    docs = docs.select("doc_id", "text")
    table = materialize(shingle_table(docs, words, percent))
    full = table.filter("n > 0 and doc_id is not null")
    classes = materialize(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    prefixes = full.select("cls", F.explode("prefix").alias("token"))
    known = labels = own = None  # pairs measured so far, the components that the linked ones make, elements of one class alone
    measured, before, paired = 0, float("inf"), min(small, PAIRED_REGION)

    def fresh(pairs: DataFrame) -> DataFrame:
        if known is None:
            return pairs
        old = known.select("a", "b")
        return pairs.join(F.broadcast(old) if measured <= BROADCAST_PAIRS else old, ["a", "b"], "left_anti")

    def verify(pairs: DataFrame, least: int = percent) -> None:
        """Measures the new pairs of which sizes and sketches leave open whether they reach ``least``; links join components."""
        nonlocal known, labels, measured
        reach = materialize(_with_classes(fresh(pairs), classes).filter(measure.possible(
            F.col("n_a"), F.col("n_b"), _differ(F.col("sketch_a"), F.col("sketch_b")), least)).select("a", "b", "n_a", "n_b"))
        n = reach.count()
        if n == 0:
            return
        sets = materialize(_of_classes(docs, classes, reach.select(F.col("a").alias("cls")).union(reach.select("b")), 2 * n, words))
        found = _measured(reach, sets, n <= BROADCAST_PAIRS).dropDuplicates(["a", "b"])
        found = materialize(found.select("a", "b", _distance(F.col("common"), F.col("n_a"), F.col("n_b")).alias("distance"),
                                         (F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).alias("linked")))
        known, measured = found if known is None else known.union(found), measured + n
        if not found.filter("linked").isEmpty():
            labels = connected_components(known.filter("linked").select("a", "b"))

    for level in range(LEVELS + 1):
        regions = materialize(_regions(prefixes, own))
        if regions.isEmpty():
            break
        regions = _by_size(regions, classes, own, small, percent)
        # spokes of the regions that hold more than one component, up to where windows need their distance
        mixed = regions
        if labels is not None:
            named = materialize(_label(regions, labels, "cls", "comp"))
            several = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
            mixed = materialize(named.join(several, "token").drop("comp"))
        verify(mixed.filter("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), measure.twice)

        # windows: what is left of each region beside its ball; a spoke without a distance is beyond 2 t
        mixed = _label(mixed, labels, "cls", "comp")
        if known is None:
            held = mixed.withColumn("distance", F.lit(None).cast("double"))
        else:
            far = known.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "distance")
            held = mixed.join(F.broadcast(far) if measured <= BROADCAST_PAIRS else far, ["cls", "pivot"], "left")
        held = held.withColumn("near", F.when(F.col("cls") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
        t = 1 - percent / 100
        kind = F.when(F.col("near") <= t + SLACK, "ball").when(F.col("near") <= 2 * t + SLACK, "border").otherwise("rest")
        held = held.join(classes.select("cls", "n"), "cls")
        held = held.withColumn("own", F.lit(0).cast("long")) if own is None else held.join(own, "cls", "left")
        held = materialize(held.select("token", "cls", "comp", "near", kind.alias("kind"), "n", F.coalesce("own", F.lit(0)).alias("own")))
        sizes = held.groupBy("token").agg(F.max(F.col("kind") == "border").alias("has_border"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.min(F.when(F.col("kind") != "ball", F.col("comp"))).alias("lo_out"),
                                          F.max(F.when(F.col("kind") != "ball", F.col("comp"))).alias("hi_out"),
                                          F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("kind") != "ball", 1).otherwise(0)).alias("outside"))
        sizes = sizes.filter(F.when(F.col("has_border"), F.col("lo") < F.col("hi")).otherwise(F.col("lo_out") < F.col("hi_out")))
        sizes = sizes.select("token", "has_border", F.when(F.col("has_border"), F.col("all")).otherwise(F.col("outside")).alias("members"))
        left = materialize(held.join(sizes, "token").filter((F.col("kind") != "ball") | F.col("has_border")))
        in_large = F.col("members") > BLOCK
        # members of a row's region summed over the rows: the comparisons that joining the large ones now would take
        now = left.agg(F.coalesce(F.sum(F.when(in_large, F.col("members"))), F.lit(0)).alias("work"), F.count_distinct(F.when(in_large, F.col("cls"))).alias("wanted"),
                       F.count(F.when(F.col("members") > paired, 1)).alias("blocks")).first()
        last = level == LEVELS or now["work"] <= FEW_COMPARISONS or 2 * now["wanted"] > before
        before = now["wanted"]
        pairs = _window_pairs(left.filter(F.col("members") <= paired), percent)
        rest = True
        if now["blocks"]:
            blocks = left.filter((F.col("members") > paired) & (F.lit(last) | ~in_large))
            # a spanning forest of likely links first: in a group of near copies it leaves few pairs of different components
            forest = materialize(_block_pairs(blocks, classes, percent, True))
            verify(pairs.union(forest.select("a", "b")).distinct())
            again = materialize(forest.filter("more").select("token").distinct())
            n = again.count()
            rest = n > 0
            blocks = blocks.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "token", "left_semi")
            pairs = _block_pairs(_label(blocks.drop("comp"), labels, "cls", "comp"), classes, percent, False).select("a", "b")
        if rest:
            verify(pairs.distinct())
        if last:
            break
        prefixes, own = _rare_prefixes(docs, classes, materialize(left.filter(in_large).select("cls").distinct()), before, words, percent, small)

    comps = _label(classes.select("cls", "rep"), labels, "cls", "comp")
    least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = comps.join(least, "comp").select("cls", "component_id")
    return table.join(named, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                                   F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row_key")


def _window_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a small region from different components that the triangle inequality and the sizes leave open.

    Elements that one class alone holds are in no intersection, so such a pair differs in all of them and in the
    difference of the other parts at least.
    """
    side = [members.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "comp", "near", "kind", "n", "own")]) for s in "ab"]
    met = side[0].join(side[1], "token").filter("cls_a < cls_b and comp_a <> comp_b")
    apart = ((F.col("kind_a") == "ball") & (F.col("kind_b") == "rest")) | ((F.col("kind_a") == "rest") & (F.col("kind_b") == "ball"))
    far = F.coalesce(F.abs(F.col("near_a") - F.col("near_b")) > 1 - percent / 100 + SLACK, F.lit(False))
    alone = F.col("own_a") + F.col("own_b")
    differ = alone + F.abs((F.col("n_a") - F.col("own_a")) - (F.col("n_b") - F.col("own_b")))
    near = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return met.filter(near & ~apart & ~far).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def _block_pairs(members: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """The same for regions beyond that, joined block by block inside tasks, where sketches decide before a pair is made.

    Members fall into blocks of about ``BLOCK``; every two blocks of a region meet in one task. Of all pairs that are
    left, a ``forest`` keeps those that connect what earlier ones do not, the likeliest of a member first; ``more`` then
    says whether their blocks have others. Returns ``token``, ``a``, ``b``, ``more``.

    Sketches go to every region of a set, so those of a forest have half the cells, or ``BLOCK_CELLS``: it holds few pairs in
    any case, and whole sketches decide on them, and on the other pairs of the blocks left.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cut = members.join(classes.select("cls", (_halved(F.col("sketch")) if forest else F.col("sketch")).alias("sketch")), "cls").withColumn("_block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other"))
    kinds = F.when(F.col("kind") == "ball", 0).when(F.col("kind") == "border", 1).otherwise(2)
    cut = cut.select("token", "_lo", "_hi", "_block", "cls", "comp", F.coalesce("near", F.lit(float("nan"))).alias("near"), kinds.alias("kind"), "n", "own", "sketch")

    def join(t: pa.Table) -> pa.Table:
        cls, comp, near, kind, n, own, block = (t[c].to_numpy() for c in ("cls", "comp", "near", "kind", "n", "own", "_block"))
        n = n.astype(np.int64)
        column = t["sketch"].combine_chunks()
        flat, ends = column.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
        lengths = np.diff(ends)
        folded = {int(x): {} for x in np.unique(lengths)}  # by own length: sketches of these rows, folded to shorter ones
        rows = {x: np.flatnonzero(lengths == x) for x in folded}
        place = np.empty(len(cls), np.int64)
        for x, at in rows.items():
            place[at] = np.arange(len(at))
            s = np.stack([flat[ends[i]:ends[i + 1]] for i in at])
            while s.shape[1] >= min(folded):
                folded[x][s.shape[1]] = s
                if s.shape[1] == 1:
                    break
                s = s[:, :s.shape[1] // 2] ^ s[:, s.shape[1] // 2:]
        within = t["_lo"][0].as_py() == t["_hi"][0].as_py()
        a, b, root, more = [], [], np.unique(comp, return_inverse=True)[1], False
        for i in range(len(cls)):
            both, near_by, apart = n + n[i], [], []
            least = own + own[i] + np.abs((n - own) - (n[i] - own[i]))
            open_ = (comp != comp[i]) & (least * (100 + percent) <= both * (100 - percent)) & (cls > cls[i]) & ((kind + kind[i] != 2) | (kind == kind[i]))
            open_ &= ~(np.abs(near - near[i]) > 1 - percent / 100 + SLACK)
            open_ &= within | (block != block[i])
            left = np.flatnonzero(open_)
            for x in np.unique(lengths[left]) if len(left) else ():
                j = left[lengths[left] == x]
                width = int(min(x, lengths[i]))
                mine, theirs = folded[int(lengths[i])][width][place[i]], folded[int(x)][width][place[j]]
                differ = np.bitwise_count(theirs ^ mine).sum(axis=1).astype(np.int64)
                fits = differ * (100 + percent) <= both[j] * (100 - percent)
                near_by.append(j[fits])
                apart.append(differ[fits] / both[j[fits]])
            if not near_by:
                continue
            j, apart = np.concatenate(near_by), np.concatenate(apart)
            if forest:
                chosen, all_ = [], len(j)
                while len(j) and (other := root[j] != root[i]).any():
                    j, apart = j[other], apart[other]
                    best = j[apart.argmin()]
                    chosen.append(best)
                    root[root == root[best]] = root[i]
                j = np.array(chosen, dtype=np.int64)
                more |= len(j) < all_
            a.append(np.full(len(j), cls[i]))
            b.append(cls[j])
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        n = len(found[0])
        return pa.table({"token": pa.array(np.full(n, t["token"][0].as_py()), pa.int64()), "a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()),
                         "more": pa.array(np.full(n, more), pa.bool_())})

    return cut.groupBy("token", "_lo", "_hi").applyInArrow(join, "token long, a long, b long, more boolean")


def _rare_prefixes(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, words: int, percent: int, often: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the ``n`` wanted classes in an order that puts elements held by more than ``often`` of them last,
    and for each class how many elements it alone holds.

    Should there be more than ``BROADCAST_IDS`` frequent elements, the most frequent go last; any common order is exact.
    """
    tokens = _of_classes(docs, classes, wanted, n, words).select("cls", F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count"), F.min("cls").alias("cls"))
    # elements that one class alone holds are summed up by class at once, so they are never written one by one
    frequent = F.col("count") > often
    counts = materialize(tokens.filter(frequent | (F.col("count") == 1)).groupBy(frequent.alias("frequent"), F.when(frequent, F.col("token")).otherwise(F.col("cls")).alias("key")).agg(
        F.count(F.lit(1)).alias("own"), F.max("count").alias("count")))
    own = counts.filter("not frequent").select(F.col("key").alias("cls"), "own")
    common = counts.filter("frequent").orderBy(F.desc("count"), "key").limit(BROADCAST_IDS).select(F.col("key").alias("token")).toArrow()
    late = docs.sparkSession.sparkContext.broadcast(np.sort(common["token"].to_numpy()))

    def first(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(late.value, s.view(np.int64)), max(0, len(late.value) - 1))
        hot = late.value[at] == s.view(np.int64) if len(late.value) else np.zeros(len(s), bool)
        return np.concatenate((s[~hot], s[hot]))[:len(s) - -(-len(s) * percent // 100) + 1]

    prefixes = materialize(_of_classes(docs, classes, wanted, n, words, first))
    return prefixes.select("cls", F.explode("items").alias("token")), own
