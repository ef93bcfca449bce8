"""Lexicon sentiment, subjectivity, misleading-wording detector, section consistency, headline sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions import text as X
from discloscope.functions.exprs import squash, total

SIGNALS = {"vague_language": V.SIGNAL_VAGUE, "superlative": V.SIGNAL_SUPERLATIVE, "hedging": V.SIGNAL_HEDGE,
           "future_language": V.SIGNAL_FUTURE, "concrete_evidence": V.SIGNAL_CONCRETE}


def prepare(df: DataFrame, column: str) -> DataFrame:
    out = df.withColumn("_low", F.lower(X.text_or_empty(F.col(column))))
    return out.withColumn("_w", X.split_words(F.col("_low")))


def finish(df: DataFrame) -> DataFrame:
    return df.drop("_low", "_w", "_sc")


def lexicon_sentiment(df: DataFrame) -> DataFrame:
    out = df.withColumn("_sc", X.word_scores(F.col("_w")))
    pos = F.aggregate("_sc", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    neg = F.aggregate("_sc", F.lit(0.0), lambda a, x: a - F.least(x, F.lit(0.0)))
    out = out.withColumns({"_pos": pos, "_neg": neg, "_cmp": X.compound(F.col("_sc"))})
    mass = F.nullif(F.col("_pos") + F.col("_neg"), F.lit(0.0))
    p, n = F.coalesce(F.col("_pos") / mass, F.lit(0.0)), F.coalesce(F.col("_neg") / mass, F.lit(0.0))
    return out.withColumns({
        "vader_compound": F.bround("_cmp", 4), "vader_positive": F.bround(p, 4), "vader_negative": F.bround(n, 4),
        "vader_neutral": F.bround(F.greatest(1.0 - p - n, F.lit(0.0)), 4)}).drop("_pos", "_neg", "_cmp")


def polarity_subjectivity(df: DataFrame) -> DataFrame:
    w = F.col("_w")
    out = df.withColumns({"_p": X.count_in(w, list(V.POSITIVE)), "_n": X.count_in(w, list(V.NEGATIVE)),
                          "_sub": X.count_in(w, V.SUBJECTIVE), "_obj": X.count_in(w, V.OBJECTIVE)})
    tone, kind = F.nullif(F.col("_p") + F.col("_n"), F.lit(0)), F.nullif(F.col("_sub") + F.col("_obj"), F.lit(0))
    empty = F.char_length("_low") == 0
    return out.withColumns({
        "polarity": F.coalesce(F.bround((F.col("_p") - F.col("_n")) / tone, 4), F.lit(0.0)),
        "subjectivity": F.when(empty, 0.0).otherwise(F.coalesce(F.bround(F.col("_sub") / kind, 4), F.lit(0.5)))
    }).drop("_p", "_n", "_sub", "_obj")


def linguistic_detector(df: DataFrame) -> DataFrame:
    """Counts and per-100-word densities of five wording families and their squashed balance; zeros for empty text."""
    out = df.withColumns({"_h": X.phrase_counts(F.col("_low"), SIGNALS), "_words": F.size("_w")})
    n = F.nullif(F.col("_words"), F.lit(0))
    dens = {k: F.coalesce(F.col(f"_h.{k}") / n * 100.0, F.lit(0.0)) for k in SIGNALS}
    raw = total([dens[k] for k in SIGNALS if k != "concrete_evidence"]) - 2.0 * dens["concrete_evidence"]
    empty = F.char_length("_low") == 0
    return out.withColumns({
        **{f"{k}_count": F.col(f"_h.{k}") for k in SIGNALS}, **{f"{k}_density": F.bround(d, 3) for k, d in dens.items()},
        "gw_linguistic_score": F.when(empty, 0.0).otherwise(F.bround(squash(raw, 0.2), 4))}).drop("_h", "_words")


def section_sentiment(df: DataFrame, sections: int = 3) -> DataFrame:
    """Sentiment of equal word sections (one section below five words each) and its consistency."""
    size = F.size("_w")
    step = F.floor(size / sections).cast("int")
    out = df.withColumn("_parts", F.when(size < sections * 5, F.array(F.col("_w"))).otherwise(F.array(*[
        F.slice("_w", step * i + 1, step if i < sections - 1 else size - step * i) for i in range(sections)])))
    names = [f"_c{i}" for i in range(sections)]
    for i, name in enumerate(names):
        out = out.withColumn(f"_p{i}", F.get("_parts", F.lit(i)))
        out = out.withColumn(name, F.bround(X.compound(X.word_scores(F.col(f"_p{i}"))), 4))
    many = F.size("_parts") > 1
    cols = [F.col(n) for n in names]
    mean = total(cols) / float(sections)
    var = total([(c - mean) * (c - mean) for c in cols]) / float(sections)
    out = out.withColumn("_var", F.when(many, var).otherwise(0.0))
    return out.withColumns({
        "sentiment_variance": F.bround("_var", 4),
        "sentiment_range": F.when(many, F.bround(F.greatest(*cols) - F.least(*cols), 4)).otherwise(0.0),
        "sentiment_consistency": F.bround(1.0 - F.least(F.col("_var") * 10.0, F.lit(1.0)), 4),
    }).drop("_parts", "_var", *names, *[f"_p{i}" for i in range(sections)])


def sentiment_label(c: Column) -> Column:
    return F.when(c >= 0.3, "positive").when(c <= -0.3, "negative").otherwise("neutral")


def all_sentiment(df: DataFrame, column: str) -> DataFrame:
    out = prepare(df, column).transform(lexicon_sentiment).transform(polarity_subjectivity)
    out = out.transform(linguistic_detector).transform(section_sentiment)
    return finish(out).withColumn("sentiment_label", sentiment_label(F.col("vader_compound")))


def headline_sentiment(title: Column) -> Column:
    """Tokens stripped to ``[a-z-]``, looked up and squashed; rounded to 4."""
    lexicon = {**V.LIVE_NEGATIVE, **V.LIVE_POSITIVE}
    weights = X.weight_map(lexicon)
    words = F.transform(X.split_words(F.lower(title)), lambda w: F.regexp_replace(w, "[^a-z\\-]", ""))
    # a map is searched entry by entry, so words go through a hash set first
    known = F.filter(words, lambda w: w.isin(sorted(lexicon)))
    s = F.aggregate(known, F.lit(0.0), lambda a, w: a + F.try_element_at(weights, w))
    return F.bround(s / F.sqrt(s * s + 15.0), 4)


FEATURES = ["vader_compound", "vader_positive", "vader_negative", "vader_neutral", "polarity", "subjectivity",
            *[f"{k}_count" for k in SIGNALS], *[f"{k}_density" for k in SIGNALS], "gw_linguistic_score",
            "sentiment_variance", "sentiment_range", "sentiment_consistency"]
