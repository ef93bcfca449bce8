"""Text expressions: cleaning, tokens, phrase counts, lexicon scans. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.functions import fixed_values as V

# every character Python's str.split() treats as a separator
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_SPACE = "[^" + SPACE[1:]
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# all but letters, digits, ``.,-`` and spaces; written out because Java tests a negated class about eight times as long
OTHER_CHARS = (r"[\x{0}-\x{8}\x{E}-\x{1B}\x{21}-\x{2B}\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}"
               r"\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]")
# a run of a-z that is not part of a longer Unicode word; looking ahead first spares the dearer look behind
ASCII_WORD = r"(?=[a-z])(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip_space(t: Column) -> Column:
    return F.btrim(t, F.lit(SPACE_CHARS))


def strip_html(t: Column) -> Column:
    return F.regexp_replace(text_or_empty(t), "<[^\\n]*?>", "")


def strip_urls(t: Column) -> Column:
    return F.regexp_replace(text_or_empty(t), f"https?://{NON_SPACE}+|www\\.{NON_SPACE}+", "")


def keep_charset(t: Column) -> Column:
    return F.regexp_replace(text_or_empty(t), OTHER_CHARS + "++", "")


def strip_numbers(t: Column) -> Column:
    word = r"[\p{L}\p{N}_]"
    return F.regexp_replace(text_or_empty(t), rf"(?<!{word})\d+\.?\d*(?:(?<=\d)(?!{word})|(?<=\.)(?={word}))", "")


def collapse_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(t), f"{SPACE}+", " "))


def clean(t: Column) -> Column:
    return collapse_space(strip_numbers(keep_charset(F.lower(strip_urls(strip_html(t))))))


def split_words(t: Column) -> Column:
    """Whitespace tokens without empty ends."""
    return F.filter(F.split(text_or_empty(t), f"{SPACE}+"), lambda w: w != "")


def plain_space(t: Column) -> Column:
    """Every Unicode space as an ASCII one, so that later passes can use the cheap ``\\S``."""
    return F.regexp_replace(text_or_empty(t), r"[\x{1C}-\x{1F}\x{85}\p{Z}&&[^ ]]", " ")


def count_words(plain: Column) -> Column:
    """Number of whitespace tokens of a ``plain_space`` text; a split is faster than counting matches, which are built too."""
    return F.size(F.array_remove(F.split(plain, r"\s++"), ""))


def ascii_words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(ASCII_WORD), F.lit(0))


def literal_array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def phrase_count(t: Column, terms: Sequence[str], whole_word: bool = False) -> Column:
    """Non-overlapping hits summed over one short dictionary, inside the JVM.

    Substring hits by default; ``whole_word`` counts terms bounded by non-word characters.
    For several or long dictionaries use ``phrase_counts``.
    """
    if whole_word:
        return F.aggregate(
            literal_array([rf"(?<![\p{{L}}\p{{N}}_])\Q{k}\E(?![\p{{L}}\p{{N}}_])" for k in terms]), F.lit(0).cast("long"),
            lambda acc, k: acc + F.regexp_count(t, k).cast("long"))
    size = F.octet_length(t)
    # hits * length(term) == bytes removed when the term is deleted
    return F.aggregate(
        literal_array(terms), F.lit(0).cast("long"),
        lambda acc, k: acc + F.floor((size - F.octet_length(F.replace(t, k, F.lit("")))) / F.octet_length(k)))


def _phrase_counter(dictionaries: dict[str, Sequence[str]]):
    """Makes, inside a task, the function from a text to its hits per dictionary."""
    owners: dict[str, list[int]] = {}
    for i, name in enumerate(dictionaries):
        for term in dictionaries[name]:
            owners.setdefault(term, []).append(i)

    def make():
        import ahocorasick
        machine = ahocorasick.Automaton()
        for k, (term, ids) in enumerate(owners.items()):
            machine.add_word(term, (k, len(term), ids))
        machine.make_automaton()

        def hits(text: str, into) -> None:
            taken: dict[int, int] = {}
            for end, (k, size, ids) in machine.iter(text):
                if taken.get(k, -1) <= end - size:
                    taken[k] = end
                    for i in ids:
                        into[i] += 1
        return hits
    return make


def phrase_counts(t: Column, dictionaries: dict[str, Sequence[str]]) -> Column:
    """Struct of non-overlapping substring hits per dictionary, in one scan of the text.

    Hundreds of terms make the JVM form (one ``replace`` per term) about 35 times slower
    than one pass of a term automaton over each Arrow batch, so this is one of the few
    Python steps; README gives the measurement.
    """
    names, make = list(dictionaries), _phrase_counter(dictionaries)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hits = make()
        for batch in batches:
            counts = np.zeros((len(batch), len(names)), dtype="int64")
            for row, value in enumerate(batch):
                hits(value or "", counts[row])
            yield pd.DataFrame(counts, columns=names)

    returns = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return F.pandas_udf(returns)(scan)(t)


#: what ``text_figures`` counts: ``[a-z]+`` words that are no part of longer ones (their letters, those of six letters and of
#: three vowel runs, syllables, hits of two word lists, distinct ones, single ones, the ten most frequent) and years; then
#: sentence pieces of over 5 and of over 3 characters, short and long ones, white-space tokens, those with a digit or a capital first
FIGURES = ("words", "letters", "long_words", "complex_words", "syllables", "positive", "negative", "distinct", "single", "top_ten", "years",
           "sentences", "pieces", "short_pieces", "long_pieces", "tokens", "digits", "capitals")
#: words whose figures a task remembers
KNOWN_WORDS = 200_000


def text_figures(t: Column, lowered: Column, dictionaries: dict[str, Sequence[str]], positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Struct of ``phrase_counts``, of ``FIGURES`` and of ``piece_variance`` (of the tokens of a piece), in one scan of the text.

    With higher-order functions and a dozen patterns over every text, the text packs took about three times as long.
    """
    names, make, liked, disliked = list(dictionaries), _phrase_counter(dictionaries), frozenset(positive), frozenset(negative)

    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import re
        import unicodedata
        from collections import Counter
        hits, word, letters = make(), re.compile(r"\w+"), re.compile("[a-z]+")
        vowels, year, stops, digit = re.compile("[aeiouy]+"), re.compile("(?:19|20)[0-9]{2}"), re.compile("[.!?]+"), re.compile(r"\d\S*")
        known: dict[str, tuple | None] = {}
        capital: dict[str, bool] = {}

        def of_word(w: str) -> tuple | None:
            if letters.fullmatch(w):
                runs = len(vowels.findall(w))
                return len(w), len(w) >= 6, runs >= 3, runs or 1, w in liked, w in disliked, 0
            return (0, 0, 0, 0, 0, 0, 1) if year.fullmatch(w) else None

        def of_words(text: str) -> tuple:
            size = length = long = complex_ = syllables = good = bad = years = 0
            repeats = []
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w, n in Counter(word.findall(text)).items():
                if w not in known:
                    known[w] = of_word(w)
                found = known[w]
                if found is None:
                    continue
                if found[6]:
                    years += n
                    continue
                size += n
                length += n * found[0]
                long += n * found[1]
                complex_ += n * found[2]
                syllables += n * found[3]
                good += n * found[4]
                bad += n * found[5]
                repeats.append(n)
            repeats.sort(reverse=True)
            return size, length, long, complex_, syllables, good, bad, len(repeats), repeats.count(1), sum(repeats[:10]), years

        def of_pieces(text: str) -> tuple:
            sizes, sentences = [], 0
            for piece in stops.split(text):
                piece = piece.strip()
                if len(piece) > 3:
                    sizes.append(len(piece.split()))
                    sentences += len(piece) > 5
            sizes = sizes or [0]
            mean, squares = sum(sizes) / len(sizes), 0.0
            for x in sizes:
                squares += (x - mean) * (x - mean)
            tokens, capitals = text.split(), 0
            for c, n in Counter([w[0] for w in tokens]).items():
                if c not in capital:
                    capital[c] = unicodedata.category(c) == "Lu"
                capitals += n * capital[c]
            return (sentences, len(sizes), sum(x < 10 for x in sizes), sum(x > 30 for x in sizes), len(tokens), len(digit.findall(text)), capitals), squares / len(sizes)

        for raws, lows in batches:
            counts, variances = np.zeros((len(raws), len(names) + len(FIGURES)), dtype="int64"), np.zeros(len(raws))
            for row, (raw, low) in enumerate(zip(raws, lows)):
                raw, low = raw or "", low or ""
                hits(low, counts[row])
                pieces, variances[row] = of_pieces(raw)
                counts[row, len(names):] = of_words(low) + pieces
            yield pd.DataFrame(counts, columns=[*names, *FIGURES]).assign(piece_variance=variances)

    returns = T.StructType([T.StructField(n, T.LongType()) for n in (*names, *FIGURES)] + [T.StructField("piece_variance", T.DoubleType())])
    return F.pandas_udf(returns)(scan)(t, lowered)


def contains_any(t: Column, terms: Sequence[str]) -> Column:
    return F.exists(literal_array(terms), lambda k: F.contains(t, k))


def count_in(words: Column, terms: Sequence[str]) -> Column:
    # isin over literals becomes a hash-set probe
    return F.size(F.filter(words, lambda w: w.isin(list(terms)))).cast("long")


def weight_map(*lexicons: dict[str, float]) -> Column:
    """One literal map; an earlier lexicon wins for a term found in several."""
    merged: dict[str, float] = {}
    for lex in reversed(lexicons):
        merged.update(lex)
    return F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), F.lit(float(v)))])


def sentence_pieces(t: Column, longer_than: int) -> Column:
    """Pieces between runs of ``.!?``, trimmed, longer than the given length."""
    return F.filter(F.transform(F.split(text_or_empty(t), r"[.!?]+"), strip_space),
                    lambda s: F.char_length(s) > longer_than)


def sentences(t: Column) -> Column:
    """Sentence split that shields abbreviations and needs a capital after the stop; pieces of 10+ characters."""
    mark = "\u0001"
    names = "|".join(V.ABBREVIATIONS)
    marked = F.regexp_replace(text_or_empty(t), rf"(?i)(?<![\p{{L}}\p{{N}}_])({names})\.", f"{mark}$1<PERIOD>")
    # the abbreviation itself comes out in lower case
    parts = F.transform(F.split(marked, mark), lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.lower(F.substring_index(p, "<PERIOD>", 1)),
                 F.substring(p, F.char_length(F.substring_index(p, "<PERIOD>", 1)) + 1, F.char_length(p)))))
    guarded = F.array_join(parts, "")
    pieces = F.split(guarded, rf"(?<=[.!?]){SPACE}+(?=[A-Z])")
    return F.filter(F.transform(pieces, lambda s: strip_space(F.replace(s, F.lit("<PERIOD>"), F.lit(".")))),
                    lambda s: F.char_length(s) >= 10)


def word_scores(words: Column, positive=None, negative=None, intensifiers=None, negations=None) -> Column:
    """Score of each token after intensifier and negation; unknown tokens are 0."""
    positive, negative = positive or V.POSITIVE, negative or V.NEGATIVE
    known = sorted({*positive, *negative})
    lexicon = weight_map(positive, negative)
    boost = weight_map(intensifiers or V.INTENSIFIERS)
    deny = literal_array(negations or V.NEGATIONS)

    def one(w, i):
        base = F.try_element_at(lexicon, w)
        factor = F.when(i > 0, F.coalesce(F.try_element_at(boost, F.get(words, i - 1)), F.lit(1.0))).otherwise(1.0)
        before = F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        flip = F.when(F.arrays_overlap(before, deny), F.lit(-0.75)).otherwise(1.0)
        return F.when(w.isin(known), base * factor * flip).otherwise(F.lit(0.0))

    return F.transform(words, one)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def compound(scores: Column) -> Column:
    s = array_sum(scores)
    return s / F.sqrt(s * s + 15.0)
