import math

import numpy as np
import pyarrow as pa

from discloscope.llm.hard_negatives import _negatives_in_tile, _positives_in_tile, _spanning_tree, _Walk, hard_negatives
from discloscope.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, edge double"


def brute(anchors, rows, k=5, m=5, low=80, high=100):
    def ready(rs):
        return {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rs
                if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    told, out = ready(rows), []
    clip = lambda x: max(-2**63, min(2**63 - 1, x))
    first = {}
    for i, l, v in sorted(ready(anchors)):
        first.setdefault(i, (l, v))
    for i, (l, v) in first.items():
        scored = [(clip(sum(a * b for a, b in zip(v, w))), j, m_) for j, m_, w in told if j != i and len(w) == len(v)]
        best = sorted({(-s, j) for s, j, m_ in scored if m_ == l})[:k]
        for s, j in best:
            inside = sorted({(-t, n) for t, n, m_ in scored if m_ != l and low * -s <= 100 * t <= high * -s})[:m]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(set(out))


def run(spark, anchors, rows, **kw):
    frames = [spark.createDataFrame([(i, v, l, "x", 0.5) for i, v, l in rs], SCHEMA) for rs in (anchors, rows)]
    return sorted(tuple(r) for r in hard_negatives(*frames, **kw).collect())


def sample(rng, n, near=0.0, dim=6, labels=3):
    """Vectors around a few middles: close ones make narrow bounds."""
    middles = rng.integers(-8, 9, (4, dim)) / 8
    return [(i, [float(x) for x in middles[i % 4] + near * rng.integers(-4, 5, dim) / 64], int(rng.integers(0, labels))) for i in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = sample(rng, 150, near=1.0)
    rows += [rows[3], rows[3], (3, rows[9][1], 1), (3, rows[3][1], 2), (500, None, 1), (501, [1.0, None] * 3, 1), (502, [float("nan")] * 6, 0), (503, [float("inf")] * 6, 0),
             (None, [1.0] * 6, 1), (504, [1.0] * 6, None), (505, [1.0, 2.0], 0), (506, [1.0, 3.0], 0), (507, [1.0, 2.5], 1), (508, [], 1), (509, [], 2), (510, [0.0] * 6, 1), (511, [0.0] * 6, 2)]
    anchors = [r for r in rows if r[0] is None or r[0] % 5 == 0 or r[0] in (3, 505, 506, 507, 508, 510)]
    want = brute(anchors, rows)
    assert len(want) > 100
    assert run(spark, anchors, rows) == want
    assert run(spark, anchors, rows, block=7, tile=20, fan_in=2) == want
    assert run(spark, anchors, rows, positives=2, negatives=3, low=95, block=1000, tile=40) == brute(anchors, rows, 2, 3, 95)


def test_far_values_and_none(spark):
    rows = [(1, [3e38, 1.0], 0), (2, [2.9e38, 1.0], 0), (3, [2.8e38, 0.0], 1), (4, [1.0, 1.0], 1), (5, [-3e38, 1.0], 0)]
    assert run(spark, rows, rows) == brute(rows, rows)
    assert run(spark, [], rows) == [] and run(spark, rows, []) == [] and run(spark, rows[:1], rows[:1]) == []


def test_bounds_hold_and_spare_work():
    """Along the tree every true score lies in its interval, and tight blocks need few scores."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    anchors = pa.table({"dim": [16] * 60, "block": [0] * 60, "vec_id": list(range(60)), "label": [0] * 60, "embedding": [list(base + 0.002 * rng.normal(size=16)) for _ in range(60)]})
    tree = _spanning_tree(256.0)(anchors)
    assert tree["parent"].to_pylist()[0] == -1 and all(0 <= p < i for i, p in enumerate(tree["parent"].to_pylist()) if i)
    candidates = pa.table({"vec_id": list(range(1000, 1400)), "label": [i % 2 for i in range(400)], "c_tile": [0] * 400, "embedding": [list(rng.normal(size=16)) for _ in range(400)]})
    walk, scored = _Walk(tree, candidates, 256.0, 100), 0
    for node, lo, hi in walk:
        true = walk.c @ walk.a[node]
        assert (lo <= true).all() and (true <= hi).all()
        wanted = hi >= np.partition(lo, 395)[395]
        scored += len(walk.score(node, lo, hi, wanted))
    assert scored < 60 * 400 / 10
    found = _positives_in_tile(5, 256.0)(tree, candidates)
    assert found.num_rows == 300
    windows = pa.array([[{"rank": 1, "vec_id": 7, "score": 10 ** 5}] for _ in range(60)])
    assert _negatives_in_tile(5, 80, 100, 256.0)(tree.append_column("windows", windows), candidates).num_rows > 0


def test_query(spark, sf):
    import duckdb
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(SQL["op12_hard_negatives"]).fetchall()) and got
