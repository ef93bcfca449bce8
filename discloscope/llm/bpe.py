"""Byte-level BPE by a depth-first walk over the trie of distinct words.

The encoding of a word ends with exactly one token, and what stands before that token is again encoded as it would be
alone. So every prefix of a word, a node of the trie, is known by its last token: the one token that ends there and
keeps apart from the last token of the prefix before it. A node's state is made from states on its own path, once for
all words below it, and a word's encoding is read off backwards.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from discloscope.llm.common import PORTION, portions, without

#: distinct words, and characters of them, that a task remembers before it starts anew
WORDS, LETTERS = 1 << 18, 1 << 24
#: fixed value: how the byte-level vocabulary cuts a text into words
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """A byte-level BPE tokenizer file: token bytes, merge ranks, and texts that stand for one token.

    Only what decides ids is read: no normaliser, the byte-level pre-tokenizer without a prefix space, merges whose
    parts were made before them. Anything else raises ``ValueError``.
    """

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model, pre = parsed["model"], parsed.get("pre_tokenizer") or {}
        plain = not (parsed.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")
                     or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if not plain or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        byte_of = _byte_letters()
        ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        named = {bytes(byte_of[c] for c in token): token for token in model["vocab"] if all(c in byte_of for c in token)}
        self.marks = {}
        for t in parsed.get("added_tokens") or []:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
                raise ValueError(f"added token {t['content']!r} needs more than its own text")
            self.marks[t["content"]] = t["id"]
        n = 1 + max([*ids.values(), *self.marks.values()], default=0)
        self.bytes = [b""] * n
        for token, i in ids.items():
            self.bytes[i] = token
        for token, i in self.marks.items():
            self.bytes[i] = token.encode()
        #: the two parts of a token that is merged, and the rank of that merge
        self.left, self.right, self.rank, self.pairs = [-1] * n, [-1] * n, [-1] * n, {}
        whole = {b for b in range(256) if bytes([b]) in ids}
        if len(whole) < 256:
            raise ValueError("not every byte has a token")
        made = {ids[bytes([b])] for b in range(256)}
        for rank, merge in enumerate(model["merges"]):
            a, b = ([bytes(byte_of[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge)])
            x, y, z = ids[a], ids[b], ids.get(a + b)
            if z is None or z in made or x not in made or y not in made:
                raise ValueError(f"merge {rank} of {named.get(a)} and {named.get(b)} has a part made later, or a second way to its token")
            self.left[z], self.right[z], self.rank[z], self.pairs[x, y] = x, y, rank, rank
            made.add(z)
        # a token occurs only if its own bytes are encoded as it; merges come in order of rank, so parts are judged first
        self.ids = {bytes([b]): ids[bytes([b])] for b in range(256)}
        for z in sorted((z for z in made if self.rank[z] >= 0), key=self.rank.__getitem__):
            x, y = self.left[z], self.right[z]
            if self.bytes[x] in self.ids and self.bytes[y] in self.ids and self.apart(x, y, self.rank[z]):
                self.ids[self.bytes[z]] = z
        #: bytes of the longest token of three bytes or more with these last three
        self.reach: dict[bytes, int] = {}
        for token in self.ids:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 3))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(Path(path).read_text(encoding="utf-8"))

    def apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank less than ``before`` crosses from token ``a`` to a token ``b`` behind it.

        While ``a`` and ``b`` are made, the parts at the border are those on the right edge of ``a`` and the left edge
        of ``b``; each is there until the merge that takes it in. Of merges of one rank the leftmost comes first.
        """
        pairs, left, right, ranks = self.pairs, self.left, self.right, self.rank
        edge, gone = [], before
        while b >= 0:
            edge.append((b, gone))
            b, gone = left[b], ranks[b]
        gone = before
        while a >= 0:
            for v, v_gone in edge:
                if (a, v) in pairs and pairs[a, v] < gone and pairs[a, v] < before and pairs[a, v] <= v_gone:
                    return False
            a, gone = right[a], ranks[a]
        return True


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the rest by the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def trie_walk(vocabulary: Vocabulary, words: Iterable[bytes], known: dict[int, bool]) -> Iterator[tuple[bytes, list[int]]]:
    """Every word with its ids. Sorted, distinct words are their trie in depth-first order: of the trie only the path
    to the present word is held, and the states that a word shares with the one before it are kept. ``known`` remembers
    pairs of tokens that were looked at."""
    ids, reach, apart = vocabulary.ids, vocabulary.reach, vocabulary.apart
    width = len(vocabulary.bytes)
    size = [len(b) for b in vocabulary.bytes]
    path, before = [-1], b""
    for word in sorted(set(words)):
        at, most = 0, min(len(word), len(before))
        while at < most and word[at] == before[at]:
            at += 1
        del path[at + 1:]
        for end in range(at + 1, len(word) + 1):
            n = reach.get(word[end - 3:end], 2) if end > 2 else end
            n = n if n < end else end
            while True:
                token = ids.get(word[end - n:end])
                if token is not None:
                    if n == end:
                        break
                    pair = path[end - n] * width + token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= WORDS:
                            known.clear()
                        fits = known[pair] = apart(path[end - n], token)
                    if fits:
                        break
                n -= 1  # one byte at the latest: every prefix has a last token
            path.append(token)
        out, end = [], len(word)
        while end:
            out.append(path[end])
            end -= size[path[end]]
        out.reverse()
        before = word
        yield word, out


def newer_letters() -> str:
    """What the pattern's tables know as characters and older tables do not."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not chr(c).isprintable()]
    return "".join(regex.findall(r"[\p{L}\p{M}\p{N}\p{P}\p{S}]", "".join(map(chr, points))))


def word_splitter(marks: dict[str, int], newer: str) -> Callable[[str], list[str]]:
    """Cuts a text into words; a mark is a word of its own.

    Texts with letters or digits of ``newer``, which the tokenizer library may not know, are cut by its own splitter.
    """
    pieces, late = regex.compile(PIECES), frozenset(newer)
    cut = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")") if marks else None
    library = None

    def plain(text: str) -> list[str]:
        nonlocal library
        if text.isascii() or late.isdisjoint(set(text)):
            return pieces.findall(text)
        if library is None:
            from tokenizers import pre_tokenizers
            library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if cut is None or not any(m in text for m in marks):
            return plain(text)
        return [w for i, part in enumerate(cut.split(text)) for w in ([part] if i % 2 else plain(part))]
    return split


class _Encoder:
    """Words seen so far and their ids, in one task."""

    def __init__(self, vocabulary: Vocabulary, newer: str):
        self.vocabulary, self.split, self.pairs = vocabulary, word_splitter(vocabulary.marks, newer), {}
        self.forget()

    def forget(self) -> None:
        self.index, self.letters = {}, 0
        self.flat, self.starts = array("i"), array("q", [0])
        for mark, i in self.vocabulary.marks.items():
            self.add(mark, [i])

    def add(self, word: str, ids: list[int]) -> None:
        self.index[word] = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.letters += len(word)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text of a portion: list<int32>."""
        if len(self.index) > WORDS or self.letters > LETTERS:
            self.forget()
        words = [self.split(t) if t else [] for t in texts.to_pylist()]
        fresh = {w.encode("utf-8"): w for w in set().union(*words).difference(self.index)}
        for word, ids in trie_walk(self.vocabulary, fresh, self.pairs):
            self.add(fresh[word], ids)
        ends = np.cumsum([0, *map(len, words)])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, ends[-1])
        starts = np.array(self.starts, np.int64)
        ids, counts = _gather(np.array(self.flat, np.int32), starts[at], starts[at + 1] - starts[at])
        sums = np.concatenate(([0], np.cumsum(counts)))
        return pa.ListArray.from_arrays(pa.array(sums[ends], pa.int32()), pa.array(ids, pa.int32()))


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` from ``starts``, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(total)], counts


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """All rows with all columns but ``column``, and ``ids`` (array of int), the token ids of its whole text.

    A null or empty text has no ids. Texts of the vocabulary's added tokens become their ids. Equal rows are encoded
    each; an empty table gives no rows; an input column ``ids`` gives way. A task takes texts portion by portion and
    remembers a bounded number of distinct words, so its memory depends on the longest text only.
    """
    kept = without(docs, column, "ids")
    given = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{column}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, newer_letters()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(*shared.value)
        for batch in batches:
            for part in portions(batch, "_text"):
                ids = encoder.encode(part.column("_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return given.mapInArrow(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids", name: str = "decoded") -> DataFrame:
    """All rows and columns with the text that the ids of ``column`` stand for, added tokens included.

    Bytes that are not UTF-8 become U+FFFD. Null ids give null; no ids give the empty text; ids outside the vocabulary
    and null ids in a list stand for nothing. An input column of the new name gives way.
    """
    kept = without(docs, name, "_ids")
    given = kept.withColumn("_ids", F.col(f"`{column}`").cast("array<int>"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [*shared.value, b""]
        flat, sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column("_ids")
            bounds, at = np.asarray(lists.offsets), 0
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PORTION // 4, "right")) - 1)
                ids = lists.values.slice(bounds[at], bounds[end] - bounds[at]).fill_null(-1).to_numpy().astype(np.int64)
                ids[(ids < 0) | (ids >= len(tokens))] = len(tokens) - 1
                data, counts = _gather(flat, starts[ids], sizes[ids])
                ends = np.concatenate(([0], np.cumsum(counts)))[bounds[at:end + 1] - bounds[at]]
                part = batch.slice(at, end - at)
                texts = [data[lo:hi].tobytes().decode("utf-8", "replace") if known else None
                         for lo, hi, known in zip(ends[:-1], ends[1:], part.column("_ids").is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], name])
                at = end

    return given.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, StringType())]))
