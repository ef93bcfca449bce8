"""Text feature packs. The text is lowered, tokenised and scanned once; every pack reads the counts of that scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions import text as X
from discloscope.functions.exprs import EPS, argmax, clip, normalized_entropy, row_mean, row_std, squash, total

SIZE, HITS = "_n", "_hits"
POLICIES = {"paris_agreement": V.POLICY_PARIS, "eu_taxonomy": V.POLICY_EU, "sec_climate": V.POLICY_SEC, "tcfd": V.POLICY_TCFD,
            "sdg": V.POLICY_SDG, "gri_standards": V.POLICY_GRI}
PILLAR_KEYS = {"env": V.KEY_ENV, "social": V.KEY_SOCIAL, "gov": V.KEY_GOV}
WORDING = {"vague_language": V.VAGUE, "hedge_language": V.HEDGE, "superlative": V.SUPERLATIVE, "future_language": V.FUTURE,
           "concrete_evidence": V.CONCRETE}
INTENTS = {"promotional": V.INTENT_PROMOTIONAL, "defensive": V.INTENT_DEFENSIVE, "factual": V.INTENT_FACTUAL,
           "strategic": V.INTENT_STRATEGIC}
TENSES = {"past_achievement": V.TENSE_PAST, "present_action": V.TENSE_PRESENT, "specific_future": V.TENSE_DATED_FUTURE,
          "vague_future": V.TENSE_VAGUE_FUTURE}
DICTIONARIES = {**PILLAR_KEYS, **WORDING, **POLICIES, **INTENTS, **TENSES}


def prepare(df: DataFrame, text_column: str = "description", dictionaries: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Adds the phrase hits and figures of the text (``text_figures``) and the number of its words (at least 1) as working columns."""
    text = X.text_or_empty(F.col(text_column))
    out = df.withColumn(HITS, X.text_figures(text, F.lower(text), {**DICTIONARIES, **(dictionaries or {})}, V.PACK_POSITIVE, V.PACK_NEGATIVE))
    return out.withColumn(SIZE, F.greatest(_hits("words"), F.lit(1)).cast("double"))


def finish(df: DataFrame) -> DataFrame:
    return df.drop(SIZE, HITS)


def _hits(name: str) -> Column:
    return F.col(f"{HITS}.{name}")


def polarity_pack(df: DataFrame) -> DataFrame:
    pos, neg, n = _hits("positive"), _hits("negative"), F.col(SIZE)
    return df.withColumns({
        "text_polarity": (pos - neg) / n, "text_positive_ratio": pos / n, "text_negative_ratio": neg / n,
        "text_sentiment_strength": F.abs((pos - neg) / n), "text_pos_neg_ratio": (pos / n + EPS) / (neg / n + EPS)})


def readability_pack(df: DataFrame) -> DataFrame:
    """Syllables are vowel runs, at least one per word; a complex word has three or more."""
    n, some = F.col(SIZE), _hits("words") > 0
    per_sentence, share = n / F.greatest(_hits("sentences"), F.lit(1)).cast("double"), _hits("complex_words") / n

    def guarded(e: Column) -> Column:
        return F.when(some, e).otherwise(0.0)

    return df.withColumns({
        "avg_word_length": guarded(_hits("letters") / n), "avg_sentence_length": guarded(per_sentence),
        "syllable_ratio": guarded(share),
        "flesch_reading_ease": guarded(206.835 - 1.015 * per_sentence - 84.6 * (_hits("syllables") / n)),
        "gunning_fog_index": guarded(0.4 * (per_sentence + 100.0 * share)),
        "long_word_ratio": guarded(_hits("long_words") / n)})


def vocabulary_pack(df: DataFrame) -> DataFrame:
    n, unique = F.col(SIZE), _hits("distinct")
    return df.withColumns({
        "total_word_count": _hits("words"), "unique_word_count": unique, "lexical_diversity": unique / n,
        "hapax_legomena_ratio": _hits("single") / n, "top_word_concentration": _hits("top_ten") / n,
        "avg_word_frequency": F.when(unique > 0, n / F.nullif(unique, F.lit(0))).otherwise(0.0)})


def _count_and_density(df: DataFrame, names: Sequence[str], count: str, density: str) -> DataFrame:
    return df.withColumns({
        **{count.format(k): _hits(k) for k in names}, **{density.format(k): _hits(k) / F.col(SIZE) for k in names}})


def keyword_pack(df: DataFrame) -> DataFrame:
    out = _count_and_density(df, list(PILLAR_KEYS), "{}_keyword_count", "{}_keyword_density")
    counts = [F.col(f"{p}_keyword_count") for p in ("env", "social", "gov")]
    densities = [F.col(f"{p}_keyword_density") for p in ("env", "social", "gov")]
    return out.withColumns({
        "total_esg_keyword_count": total(counts), "total_esg_keyword_density": total(counts) / F.col(SIZE),
        "esg_keyword_balance": row_std(densities, sample=False), "dominant_keyword_pillar": argmax(densities)})


def linguistic_pack(df: DataFrame) -> DataFrame:
    out = _count_and_density(df, list(WORDING), "{}_count", "{}_density")
    v, h, s, f, c = (F.col(f"{k}_density") for k in WORDING)
    return out.withColumns({
        "greenwashing_signal_score": squash(v + h + s + f - 2.0 * c, 10.0),
        "vague_to_concrete_ratio": (F.col("vague_language_count") + F.col("hedge_language_count") + EPS) / (F.col("concrete_evidence_count") + EPS)})


def structure_pack(df: DataFrame, text_column: str = "description") -> DataFrame:
    raw, pieces, tokens = X.text_or_empty(F.col(text_column)), _hits("pieces").cast("double"), F.greatest(_hits("tokens"), F.lit(1))
    return df.withColumns({
        "sentence_count": _hits("pieces"), "sentence_length_variance": _hits("piece_variance"),
        "short_sentence_ratio": _hits("short_pieces") / pieces, "long_sentence_ratio": _hits("long_pieces") / pieces,
        "question_mark_count": X.phrase_count(raw, ["?"]), "exclamation_count": X.phrase_count(raw, ["!"]),
        "number_density": _hits("digits") / tokens, "capitalized_word_ratio": _hits("capitals") / tokens})


def policy_pack(df: DataFrame) -> DataFrame:
    n = F.col(SIZE)
    pillar_hits = total([_hits(k) for k in PILLAR_KEYS])
    hits = [_hits(k) for k in POLICIES]
    out = df
    out = out.withColumns({
        **{f"{k}_alignment": _hits(k) / n for k in POLICIES},
        "regulatory_breadth_index": total([(h > 0).cast("int") for h in hits]) / 6.0,
        "_policy": total(hits), "_dens": F.filter(F.array(*[h / n for h in hits]), lambda d: d > 0)})
    out = out.withColumns({
        "total_policy_density": F.col("_policy") / n,
        "policy_specificity_score": F.least(F.col("_policy") / F.greatest(pillar_hits, F.lit(1)), F.lit(1.0)),
        "policy_esg_gap": squash(pillar_hits / n - F.col("_policy") / n, 15.0),
        "_m": X.array_sum(F.col("_dens")) / F.greatest(F.size("_dens"), F.lit(1))})
    sd = F.sqrt(X.array_sum(F.transform("_dens", lambda d: (d - F.col("_m")) * (d - F.col("_m")))) / F.greatest(F.size("_dens"), F.lit(1)))
    out = out.withColumn("framework_consistency_score", F.when(
        F.size("_dens") >= 2, 1.0 - F.least(sd / (F.col("_m") + EPS), F.lit(1.0))).when(F.size("_dens") == 1, 0.5).otherwise(0.0))
    return out.withColumn("regulatory_readiness_score", (
        0.35 * F.col("regulatory_breadth_index") + 0.30 * F.col("policy_specificity_score")
        + 0.20 * F.col("framework_consistency_score") + 0.15 * (1.0 - F.col("policy_esg_gap")))) \
        .drop("_policy", "_dens", "_m")


def intent_pack(df: DataFrame) -> DataFrame:
    """Reads ``text_polarity`` when present (0 otherwise)."""
    out = df.withColumns({f"{k}_intent_density": _hits(k) / F.col(SIZE) for k in INTENTS})
    p, d, f, s = dens = [F.col(f"{k}_intent_density") for k in INTENTS]
    polarity = F.coalesce(F.col("text_polarity"), F.lit(0.0)) if "text_polarity" in df.columns else F.lit(0.0)
    out = out.withColumns({
        "narrative_credibility_index": squash((f + s) / (p + d + EPS) - 1.0, 2.0),
        "promotional_dominance_score": p / (total(dens) + EPS),
        "intent_diversity_score": normalized_entropy(dens, total(dens)),
        "defensive_to_factual_ratio": squash((d + EPS) / (f + EPS) - 1.0, 2.0),
        "sentiment_intent_divergence": F.greatest(polarity, F.lit(0.0)) * (1.0 - F.least(f * 50.0, F.lit(1.0)))})
    return out.withColumn("news_greenwashing_signal", (
        0.4 * F.col("promotional_dominance_score") + 0.3 * (1.0 - F.col("narrative_credibility_index"))
        + 0.3 * F.col("sentiment_intent_divergence")))


def temporal_pack(df: DataFrame) -> DataFrame:
    out = df.withColumns({f"{k}_density": _hits(k) / F.col(SIZE) for k in TENSES})
    past, _, dated, vague = dens = [F.col(f"{k}_density") for k in TENSES]
    out = out.withColumns({
        "temporal_balance_score": normalized_entropy(dens, total(dens)),
        "commitment_credibility_score": (past + dated) / (past + dated + vague + EPS),
        "temporal_specificity_ratio": dated / (dated + vague + EPS),
        "progress_to_promise_ratio": squash(past / (dated + vague + EPS) - 1.0, 2.0),
        "year_mention_density": _hits("years") / F.col(SIZE)})
    return out.withColumn("temporal_greenwashing_signal", (
        0.35 * (1.0 - F.col("temporal_specificity_ratio")) + 0.30 * (1.0 - F.col("progress_to_promise_ratio"))
        + 0.20 * F.least(F.col("vague_future_density") * 100.0, F.lit(1.0)) + 0.15 * (1.0 - F.col("temporal_balance_score"))))


def aggregate_pack(df: DataFrame) -> DataFrame:
    """Composite scores over whichever other packs are present; absent inputs take their neutral default."""
    def get(col: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(col).cast("double"), F.lit(default)) if col in df.columns else F.lit(default)

    one, zero = F.lit(1.0), F.lit(0.0)
    polarity, diversity = get("text_polarity"), get("lexical_diversity")
    signal, concrete = get("greenwashing_signal_score", 0.5), get("concrete_evidence_density")
    specificity, readiness, gap = get("policy_specificity_score"), get("regulatory_readiness_score"), get("policy_esg_gap", 0.5)
    narrative, dominance = get("narrative_credibility_index", 0.5), get("promotional_dominance_score")
    commitment, progress = get("commitment_credibility_score", 0.5), get("progress_to_promise_ratio", 0.5)
    ease = clip(get("flesch_reading_ease") / 100.0, 0, 1)
    evidence = F.least(concrete * 100.0, one)
    grounded = concrete + get("total_policy_density")
    loose = get("vague_language_density") + get("hedge_language_density") + dominance * 0.01
    inputs = [specificity, readiness, commitment, narrative, evidence, 1.0 - signal]
    signals = [1.0 - signal, narrative, commitment, specificity, 1.0 - dominance, progress]
    out = df.withColumns({
        "policy_sentiment_interaction": specificity * F.greatest(polarity, zero),
        "readability_greenwashing_interaction": (1.0 - ease) * signal,
        "temporal_policy_interaction": commitment * readiness,
        "vocabulary_intent_interaction": diversity * F.least(get("factual_intent_density") * 100.0, one),
        "evidence_readability_interaction": evidence * ease,
        "claim_credibility_ratio": squash(grounded / (loose + EPS) - 1.0, 5.0),
        "multi_signal_greenwashing_score": 0.30 * signal + 0.25 * get("news_greenwashing_signal", 0.5)
        + 0.25 * get("temporal_greenwashing_signal", 0.5) + 0.20 * gap,
        "esg_linguistic_credibility_index": 0.20 * (specificity + readiness + commitment) + 0.15 * (narrative + evidence) + 0.10 * (1.0 - signal),
        "credibility_confidence_interval": 1.0 - F.least(row_std(inputs, sample=False) * 2.0, one),
        "policy_temporal_alignment": (readiness + commitment) / 2.0,
        "narrative_consistency_score": row_mean(signals) * (1.0 - F.least(row_std(signals, sample=False), one))})
    return out.withColumn("aggregate_esg_nlp_score", clip(100.0 * (
        0.50 * F.col("esg_linguistic_credibility_index") + 0.30 * (1.0 - F.col("multi_signal_greenwashing_score"))
        + 0.20 * F.col("narrative_consistency_score")), 0, 100))


def all_nlp(df: DataFrame, text_column: str = "description") -> DataFrame:
    out = prepare(df, text_column)
    out = out.transform(polarity_pack).transform(readability_pack).transform(vocabulary_pack).transform(keyword_pack)
    out = out.transform(linguistic_pack).transform(structure_pack, text_column).transform(policy_pack).transform(intent_pack)
    return finish(out.transform(temporal_pack).transform(aggregate_pack))


FEATURES = {
    "polarity": ["text_polarity", "text_positive_ratio", "text_negative_ratio", "text_sentiment_strength", "text_pos_neg_ratio"],
    "readability": ["avg_word_length", "avg_sentence_length", "syllable_ratio", "flesch_reading_ease", "gunning_fog_index", "long_word_ratio"],
    "vocabulary": ["total_word_count", "unique_word_count", "lexical_diversity", "hapax_legomena_ratio", "top_word_concentration", "avg_word_frequency"],
    "keyword": ["env_keyword_count", "env_keyword_density", "social_keyword_count", "social_keyword_density", "gov_keyword_count",
                "gov_keyword_density", "total_esg_keyword_count", "total_esg_keyword_density", "esg_keyword_balance", "dominant_keyword_pillar"],
    "linguistic": ["vague_language_count", "vague_language_density", "hedge_language_count", "hedge_language_density", "superlative_count",
                   "superlative_density", "future_language_count", "future_language_density", "concrete_evidence_count",
                   "concrete_evidence_density", "greenwashing_signal_score", "vague_to_concrete_ratio"],
    "structure": ["sentence_count", "sentence_length_variance", "short_sentence_ratio", "long_sentence_ratio", "question_mark_count",
                  "exclamation_count", "number_density", "capitalized_word_ratio"],
    "policy": [*(f"{k}_alignment" for k in POLICIES), "regulatory_breadth_index", "total_policy_density", "policy_specificity_score",
               "policy_esg_gap", "framework_consistency_score", "regulatory_readiness_score"],
    "intent": ["promotional_intent_density", "defensive_intent_density", "factual_intent_density", "strategic_intent_density",
               "narrative_credibility_index", "promotional_dominance_score", "intent_diversity_score", "defensive_to_factual_ratio",
               "sentiment_intent_divergence", "news_greenwashing_signal"],
    "temporal": ["past_achievement_density", "present_action_density", "specific_future_density", "vague_future_density",
                 "temporal_balance_score", "commitment_credibility_score", "temporal_specificity_ratio", "progress_to_promise_ratio",
                 "year_mention_density", "temporal_greenwashing_signal"],
    "aggregate": ["policy_sentiment_interaction", "readability_greenwashing_interaction", "temporal_policy_interaction",
                  "vocabulary_intent_interaction", "evidence_readability_interaction", "claim_credibility_ratio",
                  "multi_signal_greenwashing_score", "esg_linguistic_credibility_index", "credibility_confidence_interval",
                  "policy_temporal_alignment", "narrative_consistency_score", "aggregate_esg_nlp_score"],
}
ALL_FEATURES = [f for fs in FEATURES.values() for f in fs]
