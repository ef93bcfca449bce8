import math

import numpy as np

from discloscope.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in {i: v for i, v in sorted(vecs, reverse=True)}.items():
        hits = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in vecs if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in hits[:k]]
    return {q: h for q, h in out.items() if h}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in exact_top_k(df, df, k=3, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_ties_odd_vectors_and_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf")] * 4), (None, [1.0] * 4),
             (104, [1.0, 2.0]), (105, [3.0, 1.0]), (106, [3e38] * 4), (107, [-3e38] * 4), (5, rows[5][1])]
    want = brute(rows, 3)
    assert run(spark, rows) == want
    assert run(spark, rows, query_tile=7, candidate_tile=5, fan_in=2) == want


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0])]) == {}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {1: [(2, 131072)], 2: [(1, 131072)]}
