import hashlib
import random
import re
import zlib

import numpy as np

from discloscope.llm.queries import QUERIES
from discloscope.llm.word_runs import collapsed, common_words, runs_of, suffix_ranks, word_runs


def brute(w, exponent=4, shortest=6):
    """All runs by extending every period from every start."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, exponent * q):
                out.setdefault((i, length), q)
            i = j + 1
    return sorted((i, length, q) for (i, length), q in out.items())


def cut(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def texts(rng, n):
    for _ in range(n):
        kind, letters = rng.random(), [b"a", b"b", b"c", "é".encode()][:rng.randint(1, 4)]
        if kind < 0.5:
            yield [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        else:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            yield [rng.choice(letters) for _ in range(rng.randint(0, 5))] + unit * rng.randint(1, 7) + unit[:rng.randint(0, 3)] + [rng.choice(letters) for _ in range(rng.randint(0, 5))]


def test_runs_equal_brute_force():
    rng = random.Random(7)
    some = list(texts(rng, 1500)) + [[b"a"] * 300, [b"a", b"b"] * 200, [], [b"x"]]
    for exponent, shortest in ((4, 6), (2, 1), (2, 4), (3, 9)):
        got = runs_of(some, exponent, shortest)
        for w, runs in zip(some, got):
            assert runs == sorted(brute(w, exponent, shortest), key=lambda r: (r[0], r[2])), w
            assert collapsed(w, runs) == cut(w, runs)


def test_suffix_array_and_agreement():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        words = rng.integers(0, 2, n)
        codes = np.searchsorted(np.sort(words), words)
        places, levels = suffix_ranks(codes, 1)
        tails = [tuple(words[i:]) for i in range(n)]
        assert [tails[i] for i in places] == sorted(tails)
        for i, j, l in zip(places[:-1], places[1:], common_words(places[:-1], places[1:], levels)):
            assert tails[i][:l] == tails[j][:l] and (l == min(n - i, n - j) or tails[i][l] != tails[j][l])


def test_long_runs_stay_quick():
    words = [b"w"] * 20000 + [str(i % 700).encode() for i in range(20000)]
    assert runs_of([words], 4, 6) == [[(0, 20000, 1), (20000, 20000, 700)]]


def test_frame(spark):
    rows = [(1, " a a\ta a\x0ba a\n", "x"), (1, " a a\ta a\x0ba a\n", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (None, "b\xa0b b b b b b", "x"), (5, "a b " * 30000 + "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    out = word_runs(df)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = [(1, 6, [(0, 6, 1)], "a")] * 2 + [(2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (None, 6, [], "b\xa0b b b b b b"), (5, 60001, [(0, 60000, 2)], "a b c")]
    assert got == sorted(want, key=repr)
    assert word_runs(df.limit(0)).count() == 0


def test_query(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode())
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000 and d.doc_id % 9:
            continue  # brute force takes the square of the words
        runs = sorted(brute(w), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        assert got[d.doc_id] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
                                 hashlib.sha256(cut(w, runs)).hexdigest())
