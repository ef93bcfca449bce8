import re

from corpus_pipeline import decontamination_stage

from discloscope.llm.decontamination import contamination, remove_contaminated, remove_spans
from discloscope.llm.queries import QUERIES

DOCS, ITEMS = "doc_id long, text string, n_words string, gram string", "item_id long, text string"
PASSAGE = " ".join(f"q{i}" for i in range(20))


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if n and i is not None:
                grams.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = set()
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for g, held in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids |= held
        out.add((i, len(w), len(hit), len(ids), tuple(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def got(spark, docs, items):
    found = contamination(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in found.collect()}


ITEM_ROWS = [(1, PASSAGE), (10, PASSAGE.upper()), (2, "Tiny item"), (3, ""), (4, None), (None, "lost words here"), (5, "ééé A.b"), (6, "aa aa aa")]
DOC_ROWS = [(1, f"x {PASSAGE.replace(' ', '-')} y"), (2, "tiny, ITEM tiny item"), (3, None), (4, ""), (5, "w " * 500 + PASSAGE), (6, "ÉÉÉ a b ééé a b"),
            (7, " ".join(PASSAGE.split()[:12])), (7, "aa aa aa aa aa"), (8, PASSAGE + " " + PASSAGE), (None, "tiny item"), (9, "lost words here"), (9, "lost words here")]


def test_odd_rows(spark):
    assert got(spark, DOC_ROWS, ITEM_ROWS) == brute(DOC_ROWS, ITEM_ROWS)
    assert got(spark, DOC_ROWS, []) == brute(DOC_ROWS, [])
    assert got(spark, [], ITEM_ROWS) == set()


def test_windows_that_meet_by_shuffle(spark, monkeypatch):
    """With too many windows to broadcast, and hashes that agree for different words, the words decide."""
    from pyspark.sql import functions as F

    from discloscope.llm import decontamination
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert got(spark, DOC_ROWS, ITEM_ROWS) == brute(DOC_ROWS, ITEM_ROWS)
    monkeypatch.setattr(decontamination, "_window_hash", lambda at, length, lengths, seed=0: length.cast("long") + F.lit(seed) + 0 * at)
    assert got(spark, DOC_ROWS, ITEM_ROWS) == brute(DOC_ROWS, ITEM_ROWS)


def test_removal_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in DOC_ROWS], DOCS)
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    bad = {(r[0], r[1]) for r in brute(DOC_ROWS, ITEM_ROWS) if r[5]}
    kept = remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [(i, t) for i, t in DOC_ROWS if (i, len(words(t))) not in bad]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))
    spans = {(r.doc_id, r.text) for r in remove_spans(docs, items).collect()}
    assert (1, "x y") in spans and (9, "lost words here") in spans and (3, None) in spans and (8, "") in spans


def test_items_without_an_id_hit_too(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lost words here"), (2, "lost words here and more"), (3, "clean")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "lost words here"), (4, "and more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 0, True), (2, 5, 1, True), (3, 0, 0, False)}
    assert [r.doc_id for r in decontamination_stage(spark, docs, str(tmp_path)).collect()] == [3]
