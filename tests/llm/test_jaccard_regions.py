"""What the Jaccard join does before it compares: regions, and components of its links."""

import pytest
from pyspark.sql import functions as F

from discloscope.llm import components, jaccard_join


def test_elements_with_the_same_members_are_one_region(spark):
    """Near copies share nearly all elements; repeated rows of a class (here of 1) do not matter."""
    held = {10: [1, 1, 2], 11: [1, 1, 2], 12: [2, 1, 1], 13: [1, 1, 2, 3], 14: [1, 1, 3], 15: [4, 4], 16: [-5], 17: [2, -5, 3], 18: [2, -5, 3]}
    prefixes = spark.createDataFrame([(t, c) for t, members in held.items() for c in members], "token long, cls long")
    regions = {}
    for r in jaccard_join._regions(prefixes, None).collect():
        regions.setdefault((r.token, r.pivot), []).append(r.cls)
    assert {k: sorted(v) for k, v in regions.items()} == {(10, 1): [1, 2], (13, 1): [1, 2, 3], (14, 1): [1, 3], (17, -5): [-5, 2, 3]}
    own = spark.createDataFrame([(1, 9), (2, 4), (3, 7)], "cls long, own long")
    assert {(r.token, r.pivot) for r in jaccard_join._regions(prefixes, own).collect()} == {(10, 2), (13, 2), (14, 3), (17, -5)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i) for i in range(1, 60, 2)] + [(-3, 70), (70, 80), (9, 9), (2**62, 80)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, -3: -3, 70: -3, 80: -3, 2**62: -3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_tells_blocks_with_other_pairs(spark):
    """Three near copies need two links of a forest and have a third pair; two need one and have none left."""
    rows = [(t, c, c, None, "rest", 100, 0, 9) for t, members in {1: [1, 2, 3], 2: [4, 5], 3: [6, 7]}.items() for c in members]
    members = spark.createDataFrame(rows, "token long, cls long, comp long, near double, kind string, n int, own long, members int")
    classes = spark.createDataFrame([(c, [c if c < 6 else -(c % 2)] * 8) for c in range(1, 8)], "cls long, sketch array<long>")
    forest = {(r.token, r.more) for r in jaccard_join._block_pairs(members, classes, 80, True).collect()}
    assert forest == {(1, True), (2, False)}
    assert {(r.a, r.b) for r in jaccard_join._block_pairs(members, classes, 80, False).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_forest_takes_half_of_a_long_sketch(spark):
    """Sketches go to every region of a set, which is most of the shuffle; other pairs of a block still need whole ones."""
    rows = [(1, c, c, None, "rest", 400, 0, 9) for c in (1, 2, 3)]
    members = spark.createDataFrame(rows, "token long, cls long, comp long, near double, kind string, n int, own long, members int")
    # the last one differs from the others in 128 bits, of which folded halves show none: too far apart for 800 elements
    sketches = {1: [5] * 16, 2: [5] * 16, 3: [5 ^ 0xFF] * 8 + [5 ^ 0xFF] * 8}
    classes = spark.createDataFrame(list(sketches.items()), "cls long, sketch array<long>")
    found = {forest: {(r.a, r.b) for r in jaccard_join._block_pairs(members, classes, 80, forest).collect()} for forest in (True, False)}
    assert found == {True: {(1, 2), (1, 3)}, False: {(1, 2)}}
    halves = {r.cls: r.s for r in classes.select("cls", jaccard_join._halved(F.col("sketch")).alias("s")).collect()}
    assert halves == {c: [0] * 8 for c in sketches}
    assert spark.createDataFrame([([3] * 8,)], "s array<long>").select(jaccard_join._halved(F.col("s")).alias("s")).first().s == [3] * 8
