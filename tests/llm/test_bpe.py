import hashlib
import json
import random

import pytest

from discloscope.llm.bpe import Vocabulary, decode, encode, trie_walk
from discloscope.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def small(merges):
    """A byte-level file with the given merges of letters."""
    from discloscope.llm.bpe import _byte_letters
    tokens = [*_byte_letters(), *[a + b for a, b in merges]]
    return Vocabulary(json.dumps({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}}))


def by_rank(vocabulary, word):
    """Merges one pair at a time, the lowest rank first, the leftmost first."""
    parts = [vocabulary.ids[bytes([b])] for b in word]
    made = {(vocabulary.left[z], vocabulary.right[z]): z for z in range(len(vocabulary.bytes)) if vocabulary.rank[z] >= 0}
    while True:
        found = min(((vocabulary.pairs[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.pairs), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i:i + 2] = [made[parts[i], parts[i + 1]]]


def test_walk_equals_merging_by_rank():
    rng = random.Random(5)
    for _ in range(60):
        known, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            pair = [rng.choice(known), rng.choice(known)]
            if "".join(pair) not in known:
                merges.append(pair)
                known.append("".join(pair))
        v = small(merges)
        words = ["".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 14))).encode() for _ in range(80)]
        assert dict(trie_walk(v, words, {})) == {w: by_rank(v, w) for w in words}


def test_refuses_what_it_cannot_encode():
    with pytest.raises(ValueError):
        small([["ab", "c"], ["a", "b"]])
    with pytest.raises(ValueError):
        small([["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]])
    with pytest.raises(ValueError):
        Vocabulary(json.dumps({"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE", "vocab": {}, "merges": []}}))


def test_equals_the_library(spark, vocabulary, library):
    rng = random.Random(2)
    pool = ["a", "aaa", " ", "  ", "the", "ing", "'s", "'LL", "\n", "\t", "é", "日本", "12", "...", "<|endoftext|>", "<|endof", "==", "՘", "\U00033479", " ", "\xa0", "x" * 300, "\x85", "́", "\x00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0xd7ff), rng.randint(0xe000, 0x10ffff)])) for _ in range(30)) for _ in range(400)]
    texts += ["", None, "a" * 5000, "-" * 3000, "ab" * 4000, "same", "same", " word" * 60000]
    df = spark.createDataFrame([(i % 7, t, "old", "left") for i, t in enumerate(texts)], "doc_id long, text string, ids string, Decoded string")
    coded = encode(df, vocabulary)
    assert coded.columns == ["doc_id", "Decoded", "ids"] and dict(coded.dtypes)["ids"] == "array<int>"
    rows = decode(coded, vocabulary).collect()
    want = [tuple(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sorted(tuple(r.ids) for r in rows) == sorted(want)
    assert {tuple(r.ids): r.decoded for r in rows} == {w: library.decode(list(w), skip_special_tokens=False) for w in want}


def test_decoding_any_ids(spark, vocabulary, library):
    lists = [[128, 129, 200], [50256], [], [15496, 995], [220, 128]]
    df = spark.createDataFrame([(l,) for l in [*lists, None, [15496, -4, 99999999, None]]], "ids array<int>")
    got = [r.decoded for r in decode(df, vocabulary).collect()]
    assert got == [library.decode(l, skip_special_tokens=False) for l in lists] + [None, "Hello"]
    assert decode(df.limit(0), vocabulary).count() == 0


def test_query(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_bpe_round_trip"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
