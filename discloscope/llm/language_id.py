"""Language identification: TF-IDF character n-grams, FTRL logistic regression, temperature calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloscope.llm.common import without

#: hashed features; n-grams of one to three characters share them
FEATURES = 1 << 17
#: features times languages up to which there are that many features; beyond, n-grams share fewer, LEAST_FEATURES at least
CELLS = 1 << 23
LEAST_FEATURES = 1 << 12
#: rows of a language that are fitted however many languages there are
LEAST_ROWS = 10
#: characters worked on at a time, so a text of any length takes bounded memory
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``weights`` holds idf times coefficient for each feature and language."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _coder():
    """Maps a text piece to its code points: letters lower-cased, every run of anything else as one blank."""
    letters = np.array([chr(c).isalpha() for c in range(0x10000)])

    def codes(text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        low = np.minimum(c, 0xFFFF)
        letter = letters[low] & (c < 0x10000)
        for at in np.flatnonzero(c >= 0x10000):
            letter[at] = chr(c[at]).isalpha()
        c = np.where(letter, c, 32)
        return c[letter | np.concatenate(([True], letter[:-1]))]
    return codes


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of all n-grams of one, two and three characters."""
    out, value = [], np.zeros(len(codes), np.uint64)
    for n in range(3):
        value = (value if n == 0 else value[:-1]) * np.uint64(0x9E3779B97F4A7C15) + codes[n:].astype(np.uint64) + np.uint64(n + 1)
        out.append(((value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64))
        if len(value) < 2:
            break
    return out


def _pieces(text: str):
    for at in range(0, len(text), PIECE):
        yield text[max(0, at - 2):at + PIECE]


def features_for(n_langs: int) -> int:
    """Number of features, a power of two."""
    return min(FEATURES, max(LEAST_FEATURES, 1 << max(1, CELLS // max(1, n_langs)).bit_length() - 1))


def _shift(features: int) -> int:
    return FEATURES.bit_length() - features.bit_length()


def _document_frequencies(features: int):
    """Texts that hold each feature, and with feature -1 texts that hold any, once a task: ``feature``, ``df``."""
    def count(batches):
        codes, shift = _coder(), _shift(features)
        df, mark, texts = np.zeros(features, np.int64), np.zeros(features, bool), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for piece in _pieces(text):
                    c = codes(piece)
                    if (c != 32).any():
                        for g in _grams(c):
                            mark[g >> shift] = True
                at = np.flatnonzero(mark)
                df[at] += 1
                mark[at] = False
                texts += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1), pa.int32()), "df": pa.array(np.append(df[at], texts), pa.int64())})
    return count


def _count_features(features: int):
    """Counts of the features of each text: ``lang``, ``features``, ``counts``."""
    def count(batches):
        codes, shift = _coder(), _shift(features)
        for batch in batches:
            langs, found, counts = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen = np.zeros(features, np.int64)
                for piece in _pieces(text):
                    c = codes(piece)
                    if (c != 32).any():
                        for g in _grams(c):
                            seen += np.bincount(g >> shift, minlength=features)
                held = np.flatnonzero(seen)
                langs.append(lang)
                found.append(held.astype(np.int32))
                counts.append(seen[held].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "features": pa.array(found, pa.list_(pa.int32())),
                                              "counts": pa.array(counts, pa.list_(pa.int32()))})
    return count


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, n_langs: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Follow-the-regularised-leader with elastic net, one step a text; the last feature is the bias."""
    z, n = np.zeros((features + 1, n_langs)), np.zeros((features + 1, n_langs))

    def weights(at) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, lang = rows[i]
            w = weights(at)
            error = _probabilities(value @ w)
            error[lang] -= 1
            g = value[:, None] * error[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def _temperature(logits: np.ndarray, langs: np.ndarray) -> float:
    """Temperature with the least log loss, by golden section over its logarithm."""
    def loss(log_t: float) -> float:
        p = _probabilities(logits / np.exp(log_t))[np.arange(len(langs)), langs]
        return -np.log(np.maximum(p, 1e-300)).mean()

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, per_lang: int = 400, max_rows: int = 25_600, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
          l1: float = 0.01, l2: float = 0.01) -> Model:
    """Fits a model of every value of ``lang`` on at most ``per_lang`` rows of each.

    That is a documented limit of the fit, as its sample goes to the driver as feature counts (at most ``FEATURES`` a
    text); with many languages there are fewer rows of each, so that they are ``max_rows`` in all, but ``LEAST_ROWS``
    where there are as many. Rows are the ones with the smallest hash of their id, so the sample does not depend on the
    layout. Document frequencies are counted over all rows. Every fifth row of a language calibrates the temperature
    and is not trained on. Rows with a null text or ``lang`` are left out. With no usable rows the model knows no
    language and predicts ``und``.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = [r["lang"] for r in rows.select("lang").distinct().collect()]
    features = features_for(len(names))
    limit = min(per_lang, max(LEAST_ROWS, max_rows // max(1, len(names))))
    # the last hash of each language from narrow rows; then the rows up to it, of which repeated ids may be too many
    keyed = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_key"))
    by_key = Window.partitionBy("lang").orderBy("_key")
    cuts = keyed.select("lang", "_key").withColumn("_rank", F.row_number().over(by_key)).filter(F.col("_rank") <= limit).groupBy("lang").agg(F.max("_key").alias("_cut"))
    order = Window.partitionBy("lang").orderBy("_key", "doc_id", F.xxhash64("text"))
    near = keyed.join(F.broadcast(cuts), "lang").filter(F.col("_key") <= F.col("_cut"))
    sample = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).select("lang", "text")
    table = sample.mapInArrow(_count_features(features), "lang string, features array<int>, counts array<int>").toArrow()
    found = [(np.asarray(f, np.int64), np.asarray(c, float), lang) for lang, f, c in zip(
        table["lang"].to_pylist(), table["features"].to_pylist(), table["counts"].to_pylist()) if f]
    if not found:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32), 1.0)
    langs = sorted({lang for _, _, lang in found})
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(at, c, number[lang]) for at, c, lang in found]
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tolist(), r[1].tolist()))  # tasks end in any order

    # one row a feature
    counted = rows.select("text").mapInArrow(_document_frequencies(features), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(features + 1)
    df[counted["feature"].to_numpy()] = counted["df"].to_numpy()  # feature -1 is the last
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    scaled = [(np.append(at, features), np.append(100 * c / c.sum() * idf[at], 1.0), lang) for at, c, lang in data]
    held, fit, of = [], [], np.zeros(len(langs), int)
    for r in scaled:
        of[r[2]] += 1
        (held if of[r[2]] % 5 == 0 else fit).append(r)
    held = held or fit
    w = _ftrl(fit, features, len(langs), epochs, alpha, beta, l1, l2)
    logits = np.array([value @ w[at] for at, value, _ in held])
    return Model(langs, (100 * idf[:, None] * w[:-1]).astype(np.float32), w[-1].astype(np.float32),
                 _temperature(logits, np.array([r[2] for r in held])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score``, the calibrated probability of the predicted language.

    Only the text is looked at, all of it. A text that is null or has no letter is ``und`` with score 0, and so is
    everything if the model knows no language. Ties go to the first language by name. Input columns that clash with
    the added names give way.
    """
    docs = without(docs, "lang_pred", "score", "_guess")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.bias, model.temperature))

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        (langs, weights, bias, temperature), codes, out = shared.value, _coder(), []
        shift, step = _shift(len(weights)), max(1, (64 << 20) // max(1, len(langs)))  # bounds the rows of weights taken at once
        for text in texts:
            total, seen, letters = np.zeros(len(langs)), 0, False
            for piece in _pieces(text or ""):
                c = codes(piece)
                if (c != 32).any():
                    letters = True
                    for g in _grams(c):
                        for at in range(0, len(g), step):
                            total += weights[g[at:at + step] >> shift].sum(axis=0, dtype=np.float64)
                        seen += len(g)
            if not letters or not langs:
                out.append((UNKNOWN, 0.0))
                continue
            p = _probabilities((total / seen + bias) / temperature)
            out.append((langs[int(p.argmax())], float(min(1.0, p.max()))))
        return pd.DataFrame(out, columns=["lang", "score"])

    return docs.withColumn("_guess", guess("text")).select("*", F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("score")).drop("_guess")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
