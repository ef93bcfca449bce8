import math
import re
from collections import Counter

import pytest

from discloscope.llm.mixing import fit_exponent, mix_sources, tempered

SCHEMA = "doc_id long, text string, source string, Tokens string"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)


def test_exponent_meets_its_limits():
    shares = {"a": 0.9, "b": 0.07, "c": 0.03}
    a = fit_exponent(shares, 0.9, None, 1.0)
    w = tempered(shares, a)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()) / math.log(3), 0.9, abs_tol=1e-9)
    b = fit_exponent(shares, 0.99, 2.0, 1.0)
    assert math.isclose(max(x / shares[s] for s, x in tempered(shares, b).items()), 2.0, abs_tol=1e-6)
    assert fit_exponent({"a": 1.0}, 0.9, 2.0, 1.0) == 1.0 and fit_exponent({"a": 0.5, "b": 0.5}, 0.9, None, 1.0) == 1.0


@pytest.mark.parametrize("limits", [(0.95, 2.0), (0.999, 5.0), (None, None)])
def test_quotas_epochs_and_blocks(spark, limits):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "abcd"[0 if i % 10 < 7 else i % 4]) for i in range(1500)]
    out = mix_sources(corpus(spark, rows), *limits, blocks=8).collect()
    sizes, total = Counter(), 0
    for _, t, s in rows:
        sizes[s] += len(t.split())
    total = sum(sizes.values())
    shares = {s: n / total for s, n in sizes.items()}
    weights = tempered(shares, fit_exponent(shares, *limits, 1.0))
    used = Counter()
    for r in out:
        used[r.source] += r.tokens
        assert r.tokens == len(r.text.split()) and 0 <= r.block < 8
    for s, w in weights.items():
        assert abs(used[s] - w * total) < 8  # less than one document over the quota
        per_block = Counter()
        for r in out:
            if r.source == s:
                per_block[r.block] += r.tokens
        assert max(per_block.values()) - min(per_block.values()) < 16
    copies = Counter(r.doc_id for r in out)
    assert all(sorted(r.epoch for r in out if r.doc_id == i) == list(range(n)) for i, n in list(copies.items())[:20])
    if limits == (None, None):
        assert len(out) == len(rows) and set(copies.values()) == {1}


def test_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (3, "", None), (None, "c d e", "x"), (None, None, None)]
    out = mix_sources(corpus(spark, rows), None, None)
    assert out.columns == ["doc_id", "text", "source", "tokens", "epoch", "block", "block_order"]
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter(rows)
    assert mix_sources(corpus(spark, [])).count() == 0 and mix_sources(corpus(spark, [(1, None, "x"), (2, " \t", None)])).count() == 0
    with pytest.raises(ValueError):
        mix_sources(corpus(spark, [(i, "w", str(i)) for i in range(5)]), max_sources=4)


def test_counts_words_between_ascii_blanks_only(spark):
    text = "a b c\td\x0be\x0cf"
    assert mix_sources(corpus(spark, [(1, text, "s")])).first().tokens == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 5
