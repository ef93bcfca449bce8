"""Word shingles of whole texts as sorted 64-bit hashes, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: bits of a hash that hold its shingle's length, longest first
LENGTH_BITS = 7


def shingle_sets(size: int, chunk: int = 1 << 18) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """A function from a string array to one sorted array of distinct shingle hashes a row.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than ``size``
    words, but not none, has its whole word sequence as the one shingle; null has none. The top bits of a hash fall
    with the letters of its shingle: shingles of long words come first, which few unrelated texts share by chance.
    """
    seeds = np.random.default_rng(20240229).integers(1, 1 << 63, 260, dtype=np.uint64)
    base, step = (int(x) | 1 for x in seeds[256:258])
    letters = seeds[:256].copy()
    letters[65:91] = letters[97:123]
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    inverse = pow(base, -1, 1 << 64)

    def powers(of: int, n: int) -> np.ndarray:
        out = np.full(n, of, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and lengths of all words of a chunk, and the number of words before each row start."""
        inside = ~blank[data]
        before = np.concatenate(([False], inside[:-1]))
        before[starts[starts < len(data)]] = False  # a row ends the word of the row before
        first = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False]))
        after[starts[(starts > 0) & (starts <= len(data))] - 1] = False
        last = np.flatnonzero(inside & ~after)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * powers(base, len(data)), dtype=np.uint64)))
        hashes = (sums[last + 1] - sums[first]) * powers(inverse, len(data) + 1)[first]
        return mixed(hashes + (last - first).astype(np.uint64)), last - first + 1, np.searchsorted(first, starts)

    def ranked(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        top = (1 << LENGTH_BITS) - 1
        return (top - np.minimum(letters, top)).astype(np.uint64) << np.uint64(64 - LENGTH_BITS) | mixed(hashes) >> np.uint64(LENGTH_BITS)

    def sets(texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
            body, starts = data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            with np.errstate(over="ignore"):
                empty = np.zeros(0, np.int64)
                words, lengths, edges = word_hashes(body, starts) if len(body) else (empty.view(np.uint64), empty, np.zeros(len(starts), np.int64))
                rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
                summed = np.zeros(len(rolled), np.int64)
                for k in range(size):
                    rolled = rolled * np.uint64(step) + words[k:k + len(rolled)]
                    summed += lengths[k:k + len(rolled)]
                rolled = ranked(rolled, summed)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if hi - lo >= size:
                        yield np.unique(rolled[lo:hi - size + 1])
                    elif hi > lo:
                        value = np.full(1, hi - lo, np.uint64)
                        for w in words[lo:hi]:
                            value = value * np.uint64(step) + w
                        yield ranked(value, lengths[lo:hi].sum(keepdims=True))
                    else:
                        yield np.zeros(0, np.uint64)
            at = end
    return sets


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> column of unsigned arrays."""
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 2^k cells, for 2^k of two to four times their number (512 to 32,768).

    Two such sketches differ in no more bits than the sets in elements; halves XOR to the sketch of half the cells.
    """
    bits = 1 << max(9, min(15, len(hashes).bit_length() + 1))
    cells = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.uint64)
