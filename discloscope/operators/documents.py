"""Document operators: statistics, pillar keywords, claims, rule-based report analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions import text as X
from discloscope.functions.exprs import total
from discloscope.functions.ranking import column_quantiles


def remove_stopwords(t: Column, protect: bool = True) -> Column:
    drop = [w for w in V.STOPWORDS if not (protect and w in V.PROTECTED)]
    return F.array_join(F.filter(X.split_words(t), lambda w: ~w.isin(drop)), " ")


def with_statistics(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Seven size and complexity figures, rounded to 3; zeros for empty text."""
    out = df.withColumn("_w", X.split_words(F.col(column)))
    out = out.withColumns({
        "_s": F.size(F.filter(F.split(X.text_or_empty(F.col(column)), r"[.!?]+"), lambda s: X.strip_space(s) != "")),
        "_len": F.aggregate("_w", F.lit(0), lambda a, w: a + F.char_length(w)), "_u": F.size(F.array_distinct("_w")),
        "_l": F.size(F.filter("_w", lambda w: F.char_length(w) >= 8))})
    n, some = F.size("_w"), F.size("_w") > 0
    empty = F.char_length(X.text_or_empty(F.col(column))) == 0

    def share(x: Column) -> Column:
        return F.when(some, F.bround(x / F.nullif(n, F.lit(0)), 3)).otherwise(0.0)

    sentences = F.when(empty, 0).otherwise(F.greatest("_s", F.lit(1)))
    stats = {"word_count": n, "char_count": F.char_length(X.text_or_empty(F.col(column))), "avg_word_length": share(F.col("_len")),
             "sentence_count": sentences,
             "avg_sentence_length": F.when(empty, 0.0).otherwise(F.bround(n / F.greatest("_s", F.lit(1)), 3)),
             "unique_word_ratio": share(F.col("_u")), "long_word_ratio": share(F.col("_l"))}
    return out.withColumns({f"{prefix}{k}": v for k, v in stats.items()}).drop("_w", "_s", "_len", "_u", "_l")


def preprocess(df: DataFrame, column: str, prefix: str = "clean") -> DataFrame:
    out = df.withColumn(f"{prefix}_text", X.clean(F.col(column)))
    out = out.withColumn(f"{prefix}_text_no_stopwords", remove_stopwords(F.col(f"{prefix}_text")))
    return with_statistics(out, f"{prefix}_text", f"{prefix}_")


PILLARS = {"env": V.PILLAR_ENVIRONMENTAL, "social": V.PILLAR_SOCIAL, "gov": V.PILLAR_GOVERNANCE}
PILLAR_NAMES = {"env": "environmental", "social": "social", "gov": "governance"}


def pillar_keywords(df: DataFrame, column: str) -> DataFrame:
    """Counts and densities per 100 words by pillar; the first pillar wins a tie, 'none' without hits."""
    out = df.withColumn("_low", F.lower(X.text_or_empty(F.col(column))))
    out = out.withColumns({"_hit": X.phrase_counts(F.col("_low"), PILLARS), "_n": F.size(X.split_words(F.col("_low")))})
    hit = {p: F.col(f"_hit.{p}") for p in PILLARS}
    all_hits = total(list(hit.values()))
    top = F.greatest(*hit.values())

    def density(x: Column) -> Column:
        return F.when(F.col("_n") > 0, F.bround(x / F.nullif(F.col("_n"), F.lit(0)) * 100.0, 3)).otherwise(0.0)

    dominant = F.when(all_hits == 0, "none")
    for p, name in PILLAR_NAMES.items():
        dominant = dominant.when(hit[p] == top, name)
    return out.withColumns({
        **{f"{p}_keyword_count": h for p, h in hit.items()}, **{f"{p}_keyword_density": density(h) for p, h in hit.items()},
        "total_esg_keyword_count": all_hits, "esg_keyword_density": density(all_hits), "dominant_esg_pillar": dominant,
    }).drop("_low", "_hit", "_n")


# ------------------------------------------------------------------ claims
def sentence_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.posexplode(X.sentences(F.col(column))).alias("sentence_no", "sentence"))


def _any_match(t: Column, patterns) -> Column:
    out = F.lit(False)
    for rx in patterns:
        out = out | t.rlike(rx)
    return out


def claim_strength(low: Column) -> Column:
    parts = [(_any_match(low, V.QUANTITY_PATTERNS), 0.3), (low.rlike(V.TIMEFRAME_PATTERN), 0.2),
             (X.contains_any(low, V.VERIFICATION), 0.2), (X.contains_any(low, V.ACTION_VERBS), 0.15),
             (low.rlike(V.COMPARISON_PATTERN), 0.15)]
    return F.least(total([F.when(test, w).otherwise(0.0) for test, w in parts]), F.lit(1.0))


def claim_tense(low: Column) -> Column:
    return (F.when(X.contains_any(low, V.CLAIM_PAST), "past").when(X.contains_any(low, V.CLAIM_FUTURE), "future")
            .otherwise("unspecified"))


def extract_claims(df: DataFrame, key: str, column: str, patterns=None) -> DataFrame:
    """One claim per sentence: the first matching pattern of an ordered table.

    The table is small, so it becomes one ``coalesce(when ...)`` chain over the
    sentence instead of a join of sentences with patterns. Sentences are lowered before they become rows, else the
    filter would lower them once a pattern; a known pattern is searched only where one of its hints is.
    """
    patterns = patterns or V.CLAIM_PATTERNS
    hints = {p: V.CLAIM_HINTS[p[0]] for p in V.CLAIM_PATTERNS}
    pairs = F.transform(X.sentences(F.col(column)), lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("_low")))
    rows = df.select(key, F.posexplode(pairs).alias("sentence_no", "_s")).select(key, "sentence_no", "_s.*")

    def found(p) -> Column:
        hit = F.col("_low").rlike(p[1])
        return X.contains_any(F.col("_low"), hints[p]) & hit if p in hints else hit

    first = F.coalesce(*[F.when(found(p), F.lit(i)) for i, p in enumerate(map(tuple, patterns))])
    rows = rows.withColumn("_p", first).filter(F.col("_p").isNotNull())

    def field(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(p[i]) for p in patterns]), F.col("_p") + 1)

    match = F.coalesce(*[F.when(F.col("_p") == i, F.regexp_extract("_low", p[1], 0)) for i, p in enumerate(patterns)])
    return rows.withColumns({
        "pattern_name": field(0), "pillar": field(2), "claim_type": field(3), "claim_description": field(4), "matched_text": match,
        "strength_score": claim_strength(F.col("_low")), "has_verification": X.contains_any(F.col("_low"), V.VERIFICATION),
        "temporal": claim_tense(F.col("_low"))}).drop("_low", "_p")


def claim_metrics(entities: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Fifteen claim measures per entity; zeros for an entity without claims."""
    def share(test: Column) -> Column:
        return F.count_if(test) / F.count(F.lit(1))

    strength = F.col("strength_score")
    agg = claims.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("pillar") == "Environmental").alias("env_claims"),
        F.count_if(F.col("pillar") == "Social").alias("social_claims"), F.count_if(F.col("pillar") == "Governance").alias("gov_claims"),
        F.avg(strength).alias("_avg"), share(F.col("has_verification")).alias("_ver"), share(F.col("temporal") == "past").alias("_past"),
        share(F.col("temporal") == "future").alias("_fut"), share(F.col("claim_type") == "performance").alias("_perf"),
        share(F.col("claim_type") == "target").alias("_tar"), share(F.col("claim_type") == "credential").alias("_cred"),
        (F.max((F.col("pillar") == "Environmental").cast("long")) + F.max((F.col("pillar") == "Social").cast("long"))
         + F.max((F.col("pillar") == "Governance").cast("long"))).alias("claim_pillar_diversity"),
        share(strength >= 0.5).alias("_strong"), share(strength < 0.3).alias("_weak"))
    credibility = (0.30 * F.col("_ver") + 0.25 * F.col("_past") + 0.25 * F.col("_avg") + 0.10 * F.col("_cred")
                   + 0.10 * (F.col("claim_pillar_diversity") / 3.0))
    doubles = {"avg_claim_strength": F.col("_avg"), "verified_claim_ratio": F.col("_ver"), "past_claim_ratio": F.col("_past"),
               "future_claim_ratio": F.col("_fut"), "performance_claim_ratio": F.col("_perf"), "target_claim_ratio": F.col("_tar"),
               "credential_claim_ratio": F.col("_cred"), "strong_claim_ratio": F.col("_strong"), "weak_claim_ratio": F.col("_weak"),
               "claim_credibility_score": credibility}
    longs = ["total_claims", "env_claims", "social_claims", "gov_claims", "claim_pillar_diversity"]
    per = agg.select(key, *longs, *[F.bround(e, 4).alias(n) for n, e in doubles.items()])
    return entities.join(per, key, "left").na.fill(0, longs).na.fill(0.0, list(doubles))


CLAIM_METRICS = ["total_claims", "env_claims", "social_claims", "gov_claims", "claim_pillar_diversity", "avg_claim_strength",
                 "verified_claim_ratio", "past_claim_ratio", "future_claim_ratio", "performance_claim_ratio", "target_claim_ratio",
                 "credential_claim_ratio", "strong_claim_ratio", "weak_claim_ratio", "claim_credibility_score"]


def claim_distribution(claims: DataFrame) -> DataFrame:
    """Distribution by pillar, type and tense with shares, from one pass of grouping sets."""
    dims = ["pillar", "claim_type", "temporal"]
    sets = claims.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id(*dims).alias("g"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") == 3, "pillar").when(F.col("g") == 5, "claim_type").otherwise("temporal")
    whole = claims.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return sets.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n", (F.col("n") / whole * 100.0).alias("pct"))


def claim_strength_stats(claims: DataFrame) -> DataFrame:
    median = column_quantiles(claims, ["strength_score"], {"median": 0.5})["strength_score_median"]
    s = "strength_score"
    return claims.agg(F.count(F.lit(1)).alias("total_claims"), F.avg(s).alias("mean_strength"), F.stddev_samp(s).alias("std_strength"),
                      F.min(s).alias("min_strength"), F.max(s).alias("max_strength")).withColumn("median_strength", F.lit(median))


def claim_extremes(claims: DataFrame, key: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` strongest and weakest claims with pillar and whole sentence; equally strong ones by key, place and text."""
    def ends(kind: str, strength: Column) -> DataFrame:
        order = [strength, *[F.asc_nulls_first(c) for c in (key, "sentence_no", "sentence", "pillar")]]
        few = claims.orderBy(*order).limit(top_n)  # the window holds these rows only
        return few.select(F.lit(kind).alias("dimension"), F.col("pillar").alias("value"), "strength_score",
                          F.row_number().over(Window.orderBy(*order)).alias("position"), key, "sentence_no", "sentence")

    return ends("strongest", F.desc_nulls_last("strength_score")).unionByName(ends("weakest", F.asc_nulls_last("strength_score")))


def claim_report(claims: DataFrame, key: str, top_n: int = 10) -> DataFrame:
    """The whole report as rows: total, distribution with shares, strength figures, strongest and weakest claims.

    ``dimension`` names the section, ``value`` the group, figure or (of a single claim) pillar; what a section does
    not have is NULL. Without claims only the total of 0 is left. ``claims`` is read several times: stage it before.
    """
    def line(dimension: str, value: str, n: Column, strength: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), F.lit(value).alias("value"), n.cast("long").alias("n"),
                        strength.cast("double").alias("strength_score"))

    lines = [line("total", "claims", F.col("total_claims"), F.lit(None)),
             *[line("strength", x, F.lit(None), F.col(f"{x}_strength")) for x in ("mean", "median", "std", "min", "max")]]
    figures = claim_strength_stats(claims).select("total_claims", F.explode(F.array(*lines)).alias("s"))
    figures = figures.filter((F.col("s.dimension") == "total") | (F.col("total_claims") > 0)).select("s.*")
    return (claim_distribution(claims).unionByName(figures, allowMissingColumns=True)
            .unionByName(claim_extremes(claims, key, top_n), allowMissingColumns=True))


# ------------------------------------------------------------------ rule-based report analysis
def report_claims(df: DataFrame, key: str, column: str, max_sentences: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Flagged sentences longer than 20 characters, of the whole text unless limits for a page view are given."""
    pieces = X.sentence_pieces(F.col(column), 20)
    rows = df.select(key, F.posexplode(pieces if max_sentences is None else F.slice(pieces, 1, max_sentences)).alias("sentence_no", "s"))
    low = F.lower("s")
    rows = rows.withColumns({"vague": _any_match(low, V.REPORT_VAGUE), "super": _any_match(low, V.REPORT_SUPERLATIVE),
                             "fut": _any_match(low, V.REPORT_FUTURE), "conc": _any_match(low, V.REPORT_CONCRETE)})
    vague, sup, fut, conc = F.col("vague"), F.col("super"), F.col("fut"), F.col("conc")
    rows = rows.filter(vague | sup | fut | conc)

    def arm(a, b, c, d, e):
        return F.when(vague & ~conc, a).when(sup, b).when(fut & ~conc, c).when(conc, d).otherwise(e)

    return rows.select(
        key, "sentence_no", (F.col("s") if max_chars is None else F.substring("s", 1, max_chars)).alias("claim_text"),
        arm("HIGH", "MEDIUM", "MEDIUM", "LOW", "MEDIUM").alias("risk_level"),
        arm("Uses vague language without measurable commitments", "Superlative claims without supporting evidence",
            "Future promise without past performance data", "Contains measurable data points",
            "Requires further verification").alias("issue"),
        arm("Vague Promise", "Unverified", "Vague Promise", "Credible", "Unverified").alias("evidence_type"),
        F.when(X.contains_any(low, V.REPORT_ENVIRONMENTAL), "Environmental").when(X.contains_any(low, V.REPORT_SOCIAL), "Social")
        .otherwise("Governance").alias("category"))


def report_summary(df: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Document score and band, number of claims, red flags and positives of the whole text."""
    def firsts(level: str) -> Column:
        hits = F.collect_list(F.when(F.col("risk_level") == level, F.struct("sentence_no", "issue")))
        return F.array_join(F.transform(F.array_sort(hits), lambda x: x["issue"]), "|")

    # a list holds sentences of one document only
    per = claims.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("risk_level") == "HIGH").alias("n_high"),
        firsts("HIGH").alias("red_flags"), firsts("LOW").alias("positive_signals"))
    out = df.select(key).join(per, key, "left").na.fill(0, ["n_claims", "n_high"]).na.fill("", ["red_flags", "positive_signals"])
    score = F.least(F.lit(100), F.floor(F.col("n_high") / F.greatest("n_claims", F.lit(1)) * 100.0 + 20.0).cast("int"))
    return out.withColumn("overall_score", score).withColumn(
        "overall_risk", F.when(F.col("overall_score") >= 60, "HIGH").when(F.col("overall_score") >= 40, "MEDIUM").otherwise("LOW")) \
        .withColumn("claims_shown", F.col("n_claims").cast("long"))
