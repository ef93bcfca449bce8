import os

import pytest

from discloscope.llm.preference import format_preferences, reply_swaps, turns_of
from discloscope.llm.token_rollup import TokenRollup, bpe_count, deltas, piece_count

TURNS = "array<struct<role:string,text:string>>"


def show(turns):
    return "".join(f"<|{r}|>\n{t.replace('<|', '< |')}<|end|>\n" for r, t in turns)


def brute(c, r):
    c, r, n = c or [], r or [], 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    def side(turns):
        at, spans = 0, []
        for role, text in turns:
            start, end = at + len(f"<|{role}|>\n"), at + len(show([(role, text)]))
            spans += [(start, end)] if role == "assistant" else []
            at = end
        return show(turns), spans
    return n, show(c[:n]), *side(c[n:]), *side(r[n:])


def test_pairs(spark):
    u, a, b = ("user", "hi é"), ("assistant", "yes <|end|>"), ("assistant", "")
    cases = [([u, a], [u, b]), ([u, a], [u, a]), ([u], [u, a]), ([a], [u]), (None, [u, a]), ([], []), ([u, a, u, b], [u, a, u, a, u])]
    df = spark.createDataFrame([(c, r, "old") for c, r in cases], f"chosen {TURNS}, rejected {TURNS}, Prompt string")
    out = format_preferences(df)
    assert "Prompt" not in out.columns
    got = [(r.n_prompt_turns, r.prompt, r.chosen_completion, [tuple(s) for s in r.chosen_spans], r.rejected_completion, [tuple(s) for s in r.rejected_spans])
           for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute(c, r)) for c, r in cases)
    for r in out.collect():
        assert all(r.chosen_completion[s:e].endswith("<|end|>\n") for s, e in r.chosen_spans)


def test_turns_and_swaps(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, "a"), (1, 0, None, "a"), (1, None, "system", None), (2, 0, "assistant", "z"), (3, 0, "user", "q"),
            (None, 0, "user", "lost"), (9, 5, "assistant", "x"), (9, 5, "assistant", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in turns_of(df).collect()}
    assert turns[1] == [("system", ""), ("user", "a"), ("assistant", "b")] and turns[9] == [("assistant", "w"), ("assistant", "x")] and None not in turns
    swaps = {r.conv_id: [tuple(t) for t in r.rejected] for r in reply_swaps(df).collect()}
    assert swaps == {1: [("system", ""), ("user", "a"), ("assistant", "z")], 2: [("assistant", "")], 9: [("assistant", "w"), ("assistant", "")]}
    assert reply_swaps(df.limit(0)).count() == 0


EVENTS = "source string, lang string, version string, op string, tokens long, old_tokens long, docs string"


def test_rollup_counts_every_batch_once(spark, tmp_path):
    store = TokenRollup(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    one = spark.createDataFrame([("a", "en", "1", "insert", 5, None, ""), ("a", "en", "1", "insert", 7, None, ""), (None, None, "1", "insert", None, None, ""),
                                 ("b", "en", "1", "insert", 2, None, "")], EVENTS)
    two = spark.createDataFrame([("a", "en", "1", "revise", 9, 7, ""), ("b", "en", "1", "delete", 2, None, "")], EVENTS)
    assert store.commit("one", one) and store.commit("two", two) and not store.commit("two", two) and not store.commit("one", two)
    want = {("a", "en", "1", 2, 14), (None, None, "1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want and not store.commit("one", one)
    # a batch whose run was lost before its mark is written anew
    assert store.commit("three", two)
    os.remove(tmp_path / "store" / "batch-three" / "_SUCCESS")
    assert {tuple(r) for r in store.totals().collect()} == want
    assert store.commit("three", one) and ("a", "en", "1", 4, 26) in {tuple(r) for r in store.totals().collect()}
    store.compact()
    assert ("a", "en", "1", 4, 26) in {tuple(r) for r in store.totals().collect()} and not store.commit("two", two)
    assert deltas(one.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown op"):
        deltas(spark.createDataFrame([("a", "en", "1", "drop", 5, None, "")], EVENTS)).collect()


def test_counters(spark):
    import public_tokenizers as P
    df = spark.createDataFrame([("Hello, wörld 2x!",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(piece_count(df.text)).collect()] == [5, 0, 0]
    bpe = bpe_count(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [r[0] for r in df.select(bpe("text")).collect()][1:] == [0, 0] and df.select(bpe("text")).first()[0] >= 5


def test_null_ids_count_like_in_the_sql(spark, tmp_path):
    import duckdb

    from discloscope.llm.queries import QUERIES, SQL
    rows = [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (None, "a b", "en", "s"), (None, "c d e", None, "s"), (1, "a b", "en", "s"), (4, None, "en", None), (5, "", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in ("source", "lang", "version", "docs", "tokens")) for r in QUERIES["op6_token_counts"](spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT source, lang, version, docs, tokens FROM ({SQL['op6_token_counts']})").fetchall(), key=repr)
    assert ("s", "en", "words-1", 3, 6) in got and ("s", None, "pieces-1", 1, 3) in got
