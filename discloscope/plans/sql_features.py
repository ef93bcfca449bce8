"""SQL forms of the feature packs, labels and scores, used only to check the Spark results."""

from __future__ import annotations

from collections.abc import Sequence

from discloscope.functions import fixed_values as V
from discloscope.functions.text import SPACE
from discloscope.plans.registry import CTES, clip_sql, sigmoid_sql, text, text_list

WORD_CHARS = r"[\p{L}\p{N}_]"


def count_sql(t: str, terms: Sequence[str]) -> str:
    return (f"CAST(list_sum(list_transform({text_list(terms)}, lambda k: (length({t}) - length(replace({t}, k, ''))) // length(k)))"
            f" AS BIGINT)")


def in_count_sql(words: str, terms: Sequence[str]) -> str:
    return f"CAST(len(list_filter({words}, lambda w: list_contains({text_list(terms)}, w))) AS BIGINT)"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{SPACE}+'), lambda w: w <> '')"


def pieces_sql(t: str, longer_than: int) -> str:
    return (f"list_filter(list_transform(string_split_regex({t}, '[.!?]+'), lambda s: {strip_sql('s')}),"
            f" lambda s: length(s) > {longer_than})")


def entropy_sql(cols: Sequence[str]) -> str:
    tot = "(" + " + ".join(cols) + " + 1e-8)"
    return "-(" + " + ".join(f"({c} / {tot}) * log2({c} / {tot} + 1e-10)" for c in cols) + ") / 2.0"


def mean_sql(cols: Sequence[str]) -> str:
    return "((" + " + ".join(f"({c})" for c in cols) + f") / {float(len(cols))})"


def pop_std_sql(cols: Sequence[str]) -> str:
    m = mean_sql(cols)
    return "sqrt((" + " + ".join(f"(({c}) - {m}) * (({c}) - {m})" for c in cols) + f") / {float(len(cols))})"


def samp_std_sql(cols: Sequence[str]) -> str:
    m = mean_sql(cols)
    return "sqrt((" + " + ".join(f"(({c}) - {m}) * (({c}) - {m})" for c in cols) + f") / {float(len(cols) - 1)})"


P = ["env_risk_score", "social_risk_score", "gov_risk_score"]
T, C = "total_esg_risk_score", "controversy_score"
SH = ["env_to_total_ratio", "social_to_total_ratio", "gov_to_total_ratio"]


def q_sql(col: str, p: float, source: str) -> str:
    return f"(SELECT quantile_cont({col}, {p}) FROM {source})"


M3 = "((" + " + ".join(f"pow({x} - esg_pillar_mean, 3)" for x in P) + ") / 3.0)"
M2 = "((" + " + ".join(f"pow({x} - esg_pillar_mean, 2)" for x in P) + ") / 3.0)"

CTES.update({
    "num1": (("clean",), f"""
        SELECT *, {P[0]} / ({T} + 1e-8) AS env_to_total_ratio, {P[1]} / ({T} + 1e-8) AS social_to_total_ratio,
               {P[2]} / ({T} + 1e-8) AS gov_to_total_ratio, {P[0]} / ({P[2]} + 1e-8) AS env_gov_ratio,
               {P[0]} / ({P[1]} + 1e-8) AS env_social_ratio, {P[1]} / ({P[2]} + 1e-8) AS social_gov_ratio,
               greatest({', '.join(P)}) - least({', '.join(P)}) AS pillar_max_min_gap, {mean_sql(P)} AS esg_pillar_mean
        FROM clean"""),
    "num2": (("num1",), f"""
        SELECT *, {samp_std_sql(SH)} AS pillar_imbalance_score, greatest({', '.join(SH)}) AS dominant_pillar_strength,
               least({', '.join(SH)}) AS weakest_pillar_weakness, {T} - ({' + '.join(P)}) AS esg_risk_residual,
               pillar_max_min_gap / ({T} + 1e-8) AS pillar_range_normalized, {C} / ({T} + 1e-8) AS controversy_risk_ratio,
               {T} * (1 + {C}) AS controversy_adjusted_risk, {' + '.join(f'{s} * {s}' for s in SH)} AS risk_concentration_index,
               {M2} * 3 / 2 AS esg_pillar_variance,
               CASE WHEN {M2} > 1e-14 THEN sqrt(6.0) * {M3} / pow({M2}, 1.5) ELSE 0 END AS esg_pillar_skewness,
               sqrt({M2} * 3 / 2) / (esg_pillar_mean + 1e-8) AS esg_pillar_cv,
               ({T} - (SELECT avg({T}) FROM clean)) / ((SELECT stddev_samp({T}) FROM clean) + 1e-8) AS esg_score_zscore,
               ({C} - (SELECT avg({C}) FROM clean)) / ((SELECT stddev_samp({C}) FROM clean) + 1e-8) AS controversy_zscore
        FROM num1"""),
    "num3": (("num2",), f"""
        SELECT *, controversy_zscore - esg_score_zscore AS esg_controversy_divergence,
               {P[0]} * {C} AS env_controversy_interaction, {P[1]} * {C} AS social_controversy_interaction,
               {P[2]} * {C} AS gov_controversy_interaction, {T} * {T} AS esg_squared, {C} * {C} AS controversy_squared,
               pillar_imbalance_score * {C} AS imbalance_controversy_interact,
               {T} / (esg_pillar_mean * 3 + 1e-8) AS risk_per_pillar_point,
               CASE WHEN {P[0]} = greatest({', '.join(P)}) THEN 1 ELSE 0 END AS env_dominance_flag,
               CASE WHEN {T} < {q_sql(T, .25, 'clean')} - 1.5 * ({q_sql(T, .75, 'clean')} - {q_sql(T, .25, 'clean')})
                      OR {T} > {q_sql(T, .75, 'clean')} + 1.5 * ({q_sql(T, .75, 'clean')} - {q_sql(T, .25, 'clean')}) THEN 1 ELSE 0 END AS esg_iqr_outlier,
               CASE WHEN {q_sql(C, .75, 'clean')} > {q_sql(C, .25, 'clean')} THEN
                    CASE WHEN {C} < {q_sql(C, .25, 'clean')} - 1.5 * ({q_sql(C, .75, 'clean')} - {q_sql(C, .25, 'clean')})
                           OR {C} > {q_sql(C, .75, 'clean')} + 1.5 * ({q_sql(C, .75, 'clean')} - {q_sql(C, .25, 'clean')}) THEN 1 ELSE 0 END
                    ELSE CASE WHEN {C} <> {q_sql(C, .5, 'clean')} THEN 1 ELSE 0 END END AS controversy_iqr_outlier,
               abs({T} - {q_sql(T, .5, 'clean')}) / ((SELECT mad({T}) FROM clean) + 1e-8) AS esg_mad_score,
               abs({C} - {q_sql(C, .5, 'clean')}) / ((SELECT mad({C}) FROM clean) + 1e-8) AS controversy_mad_score
        FROM num2"""),
    "num": (("num3",), f"""
        SELECT *, 0.25 * abs(esg_score_zscore) + 0.25 * abs(controversy_zscore) + 0.2 * esg_mad_score + 0.2 * controversy_mad_score
                  + 0.1 * (esg_iqr_outlier + controversy_iqr_outlier) AS combined_anomaly_score,
               (rank() OVER (ORDER BY {T}) + (count(*) OVER (PARTITION BY {T}) - 1) / 2.0) / count(*) OVER () AS esg_percentile_rank,
               avg({T}) OVER s AS esg_sector_mean, coalesce(stddev_samp({T}) OVER s, 0) AS esg_sector_std,
               {T} - avg({T}) OVER s AS esg_vs_sector_mean,
               ({T} - avg({T}) OVER s) / (coalesce(stddev_samp({T}) OVER s, 0) + 1e-8) AS esg_sector_zscore,
               {C} - avg({C}) OVER s AS controversy_vs_sector,
               rank() OVER (PARTITION BY sector ORDER BY {T}) AS sector_rank,
               (rank() OVER (PARTITION BY sector ORDER BY {T}) + (count(*) OVER (PARTITION BY sector, {T}) - 1) / 2.0)
                 / count(*) OVER s AS sector_percentile
        FROM num3 WINDOW s AS (PARTITION BY sector)"""),
})


def total_bin_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN 2 WHEN {c} < 10 THEN 0 WHEN {c} < 20 THEN 1 WHEN {c} < 30 THEN 2 WHEN {c} < 40 THEN 3 ELSE 4 END"


def pillar_bin_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN 2 WHEN {c} < 3 THEN 0 WHEN {c} < 6 THEN 1 WHEN {c} < 10 THEN 2 WHEN {c} < 15 THEN 3 ELSE 4 END"


FAMILY = ", ".join(f"CASE WHEN regexp_matches(j, '{rx}') THEN 1 ELSE 0 END AS {n}" for n, rx in V.ISSUE_FAMILIES.items())
CTES.update({
    "bins1": (("clean",), f"""
        SELECT *, {total_bin_sql(T)} AS esg_risk_bin, {clip_sql(f'{C} - 1', 0, 4)} AS controversy_bin,
               {pillar_bin_sql(P[0])} AS env_risk_bin, {pillar_bin_sql(P[1])} AS social_risk_bin, {pillar_bin_sql(P[2])} AS gov_risk_bin,
               CASE WHEN {C} >= 4 THEN 1 ELSE 0 END AS high_controversy_flag FROM clean"""),
    "bins": (("bins1",), """
        SELECT *, env_risk_bin + social_risk_bin + gov_risk_bin AS cross_risk_bin, CASE WHEN esg_risk_bin >= 3 THEN 1 ELSE 0 END AS high_risk_flag,
               esg_risk_bin || '_' || CAST(controversy_bin AS INTEGER) AS esg_controversy_segment,
               CASE WHEN esg_risk_bin <= 1 AND controversy_bin >= 3 THEN 1 ELSE 0 END AS risk_controversy_mismatch,
               controversy_bin AS risk_controversy_gap, sector || '_' || esg_risk_bin AS sector_risk_segment,
               CASE WHEN esg_risk_bin <= 1 AND controversy_bin <= 1 THEN 3 WHEN esg_risk_bin <= 2 AND controversy_bin <= 2 THEN 2
                    WHEN esg_risk_bin <= 3 OR controversy_bin <= 3 THEN 1 ELSE 0 END AS esg_performance_tier FROM bins1"""),
    "cross1": (("bins",), """
        SELECT *, min(company_id) OVER (PARTITION BY esg_controversy_segment) AS f1, min(company_id) OVER (PARTITION BY sector_risk_segment) AS f2 FROM bins"""),
    "cat": (("cross1", "issues"), f"""
        SELECT *, dense_rank() OVER (ORDER BY f1) - 1 AS esg_controversy_segment_encoded,
               dense_rank() OVER (ORDER BY f2) - 1 AS sector_risk_segment_encoded,
               count(*) OVER (PARTITION BY sector) AS sector_frequency, count(*) OVER (PARTITION BY sector) / count(*) OVER () AS sector_proportion,
               count(*) OVER (PARTITION BY industry) AS industry_frequency, count(*) OVER (PARTITION BY industry) / count(*) OVER () AS industry_proportion,
               avg({T}) OVER s AS sector_avg_esg, avg({C}) OVER s AS sector_avg_controversy, max({T}) OVER s AS sector_max_esg,
               min({T}) OVER s AS sector_min_esg, max({T}) OVER s - min({T}) OVER s AS sector_esg_spread,
               count({T}) OVER s AS sector_company_count, avg(high_risk_flag) OVER s AS sector_high_risk_ratio,
               CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_material_issues, n AS material_issue_count, {FAMILY}
        FROM (SELECT cross1.*, material_issue_1, material_issue_2, material_issue_3,
                     CAST((material_issue_1 IS NOT NULL) AS INTEGER) + CAST((material_issue_2 IS NOT NULL) AS INTEGER) + CAST((material_issue_3 IS NOT NULL) AS INTEGER) AS n,
                     lower(coalesce(material_issue_1, '') || ' ' || coalesce(material_issue_2, '') || ' ' || coalesce(material_issue_3, '')) AS j
              FROM cross1 JOIN issues USING (company_id)) WINDOW s AS (PARTITION BY sector)"""),
})

# ---------------------------------------------------------------- text packs
HITS = {
    "h_pos": None, "h_neg": None,
    "env_keyword_count": V.KEY_ENV, "social_keyword_count": V.KEY_SOCIAL, "gov_keyword_count": V.KEY_GOV,
    "vague_language_count": V.VAGUE, "hedge_language_count": V.HEDGE, "superlative_count": V.SUPERLATIVE,
    "future_language_count": V.FUTURE, "concrete_evidence_count": V.CONCRETE,
    "h_paris_agreement": V.POLICY_PARIS, "h_eu_taxonomy": V.POLICY_EU, "h_sec_climate": V.POLICY_SEC, "h_tcfd": V.POLICY_TCFD,
    "h_sdg": V.POLICY_SDG, "h_gri_standards": V.POLICY_GRI,
    "h_promotional": V.INTENT_PROMOTIONAL, "h_defensive": V.INTENT_DEFENSIVE, "h_factual": V.INTENT_FACTUAL, "h_strategic": V.INTENT_STRATEGIC,
    "h_past_achievement": V.TENSE_PAST, "h_present_action": V.TENSE_PRESENT, "h_specific_future": V.TENSE_DATED_FUTURE,
    "h_vague_future": V.TENSE_VAGUE_FUTURE,
}
HIT_COLS = ", ".join(f"{count_sql('t', terms)} AS {k}" for k, terms in HITS.items() if terms)
POL = ["paris_agreement", "eu_taxonomy", "sec_climate", "tcfd", "sdg", "gri_standards"]
INT = ["promotional", "defensive", "factual", "strategic"]
TEN = ["past_achievement", "present_action", "specific_future", "vague_future"]
ID = [f"{k}_intent_density" for k in INT]
TD = [f"{k}_density" for k in TEN]
VOW = "list_transform(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+')))"

CTES.update({
    "tok": (("profile",), rf"""
        SELECT company_id, coalesce(description, '') AS raw, lower(coalesce(description, '')) AS t,
               list_filter(string_split_regex(lower(coalesce(description, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS w
        FROM profile"""),
    "hits": (("tok",), rf"""
        SELECT *, greatest(len(w), 1)::DOUBLE AS n, {in_count_sql('w', V.PACK_POSITIVE)} AS h_pos, {in_count_sql('w', V.PACK_NEGATIVE)} AS h_neg,
               {HIT_COLS}, {VOW} AS runs, greatest(len({pieces_sql('raw', 5)}), 1)::DOUBLE AS ns,
               list_transform({pieces_sql('raw', 3)}, lambda s: len({words_sql('s')})::DOUBLE) AS lens0, {words_sql('raw')} AS tk,
               coalesce(list_transform(map_values(list_histogram(w)), lambda c: c::BIGINT), []) AS freq,
               len(regexp_extract_all(regexp_replace(t, '({WORD_CHARS}+)', ' \1 ', 'g'), ' (?:19|20)\d\d ')) AS years
        FROM tok"""),
    "nlp1": (("hits",), f"""
        SELECT *, (h_pos - h_neg) / n AS text_polarity, h_pos / n AS text_positive_ratio, h_neg / n AS text_negative_ratio,
               abs((h_pos - h_neg) / n) AS text_sentiment_strength, (h_pos / n + 1e-8) / (h_neg / n + 1e-8) AS text_pos_neg_ratio,
               CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / n END AS avg_word_length,
               CASE WHEN len(w) = 0 THEN 0 ELSE n / ns END AS avg_sentence_length,
               CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(runs, lambda r: r >= 3)) / n END AS syllable_ratio,
               CASE WHEN len(w) = 0 THEN 0 ELSE 206.835 - 1.015 * (n / ns) - 84.6 * (list_sum(list_transform(runs, lambda r: greatest(r, 1))) / n) END AS flesch_reading_ease,
               CASE WHEN len(w) = 0 THEN 0 ELSE 0.4 * (n / ns + 100 * (len(list_filter(runs, lambda r: r >= 3)) / n)) END AS gunning_fog_index,
               CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: length(x) >= 6)) / n END AS long_word_ratio,
               len(w)::BIGINT AS total_word_count, len(list_distinct(w))::BIGINT AS unique_word_count, len(list_distinct(w)) / n AS lexical_diversity,
               len(list_filter(freq, lambda c: c = 1)) / n AS hapax_legomena_ratio,
               coalesce(list_sum(list_reverse_sort(freq)[1:10]), 0) / n AS top_word_concentration,
               CASE WHEN len(w) = 0 THEN 0 ELSE n / len(list_distinct(w)) END AS avg_word_frequency,
               {', '.join(f'{p}_keyword_count / n AS {p}_keyword_density' for p in ('env', 'social', 'gov'))},
               env_keyword_count + social_keyword_count + gov_keyword_count AS total_esg_keyword_count,
               (env_keyword_count + social_keyword_count + gov_keyword_count) / n AS total_esg_keyword_density,
               {', '.join(f'{p}_count / n AS {p}_density' for p in ('vague_language', 'hedge_language', 'superlative', 'future_language', 'concrete_evidence'))},
               (vague_language_count + hedge_language_count + 1e-8) / (concrete_evidence_count + 1e-8) AS vague_to_concrete_ratio,
               CASE WHEN len(lens0) = 0 THEN [0.0::DOUBLE] ELSE lens0 END AS lens, greatest(len(lens0), 1)::BIGINT AS sentence_count,
               {count_sql('raw', ['?'])} AS question_mark_count, {count_sql('raw', ['!'])} AS exclamation_count,
               len(list_filter(tk, lambda x: regexp_matches(x, '\\p{{Nd}}'))) / greatest(len(tk), 1) AS number_density,
               len(list_filter(tk, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / greatest(len(tk), 1) AS capitalized_word_ratio,
               {', '.join(f'h_{k} / n AS {k}_alignment' for k in POL)},
               ({' + '.join(f'CAST(h_{k} > 0 AS INTEGER)' for k in POL)}) / 6.0 AS regulatory_breadth_index,
               {' + '.join(f'h_{k}' for k in POL)} AS pol, list_filter([{', '.join(f'h_{k} / n' for k in POL)}], lambda d: d > 0) AS dens,
               {', '.join(f'h_{k} / n AS {k}_intent_density' for k in INT)}, {', '.join(f'h_{k} / n AS {k}_density' for k in TEN)},
               years / n AS year_mention_density
        FROM hits"""),
    "nlp2": (("nlp1",), f"""
        SELECT *, {pop_std_sql(['env_keyword_density', 'social_keyword_density', 'gov_keyword_density'])} AS esg_keyword_balance,
               CAST(CASE WHEN env_keyword_density >= social_keyword_density AND env_keyword_density >= gov_keyword_density THEN 0
                    WHEN social_keyword_density >= gov_keyword_density THEN 1 ELSE 2 END AS INTEGER) AS dominant_keyword_pillar,
               {sigmoid_sql('10 * (vague_language_density + hedge_language_density + superlative_density + future_language_density - 2 * concrete_evidence_density)')} AS greenwashing_signal_score,
               list_var_pop(lens) AS sentence_length_variance, len(list_filter(lens, lambda x: x < 10)) / sentence_count AS short_sentence_ratio,
               len(list_filter(lens, lambda x: x > 30)) / sentence_count AS long_sentence_ratio,
               pol / n AS total_policy_density, least(pol / greatest(total_esg_keyword_count, 1), 1.0) AS policy_specificity_score,
               {sigmoid_sql('15 * (total_esg_keyword_count / n - pol / n)')} AS policy_esg_gap,
               CASE WHEN len(dens) >= 2 THEN 1 - least(list_stddev_pop(dens) / (list_avg(dens) + 1e-8), 1.0) WHEN len(dens) = 1 THEN 0.5 ELSE 0 END AS framework_consistency_score,
               {sigmoid_sql(f'2 * (({ID[2]} + {ID[3]}) / ({ID[0]} + {ID[1]} + 1e-8) - 1)')} AS narrative_credibility_index,
               {ID[0]} / ({' + '.join(ID)} + 1e-8) AS promotional_dominance_score, {entropy_sql(ID)} AS intent_diversity_score,
               {sigmoid_sql(f'2 * (({ID[1]} + 1e-8) / ({ID[2]} + 1e-8) - 1)')} AS defensive_to_factual_ratio,
               greatest(text_polarity, 0) * (1 - least({ID[2]} * 50, 1)) AS sentiment_intent_divergence,
               {entropy_sql(TD)} AS temporal_balance_score, ({TD[0]} + {TD[2]}) / ({TD[0]} + {TD[2]} + {TD[3]} + 1e-8) AS commitment_credibility_score,
               {TD[2]} / ({TD[2]} + {TD[3]} + 1e-8) AS temporal_specificity_ratio,
               {sigmoid_sql(f'2 * ({TD[0]} / ({TD[2]} + {TD[3]} + 1e-8) - 1)')} AS progress_to_promise_ratio
        FROM nlp1"""),
    "nlp3": (("nlp2",), """
        SELECT *, 0.35 * regulatory_breadth_index + 0.3 * policy_specificity_score + 0.2 * framework_consistency_score + 0.15 * (1 - policy_esg_gap) AS regulatory_readiness_score,
               0.4 * promotional_dominance_score + 0.3 * (1 - narrative_credibility_index) + 0.3 * sentiment_intent_divergence AS news_greenwashing_signal,
               0.35 * (1 - temporal_specificity_ratio) + 0.3 * (1 - progress_to_promise_ratio) + 0.2 * least(vague_future_density * 100, 1) + 0.15 * (1 - temporal_balance_score) AS temporal_greenwashing_signal,
               least(concrete_evidence_density * 100, 1) AS ev, least(greatest(flesch_reading_ease / 100, 0), 1) AS fl
        FROM nlp2"""),
    "nlp4": (("nlp3",), f"""
        SELECT *, policy_specificity_score * greatest(text_polarity, 0) AS policy_sentiment_interaction,
               (1 - fl) * greenwashing_signal_score AS readability_greenwashing_interaction,
               commitment_credibility_score * regulatory_readiness_score AS temporal_policy_interaction,
               lexical_diversity * least(factual_intent_density * 100, 1) AS vocabulary_intent_interaction, ev * fl AS evidence_readability_interaction,
               {sigmoid_sql('5 * ((concrete_evidence_density + total_policy_density) / (vague_language_density + hedge_language_density + promotional_dominance_score * 0.01 + 1e-8) - 1)')} AS claim_credibility_ratio,
               0.3 * greenwashing_signal_score + 0.25 * news_greenwashing_signal + 0.25 * temporal_greenwashing_signal + 0.2 * policy_esg_gap AS multi_signal_greenwashing_score,
               0.2 * policy_specificity_score + 0.2 * regulatory_readiness_score + 0.2 * commitment_credibility_score + 0.15 * narrative_credibility_index + 0.15 * ev + 0.1 * (1 - greenwashing_signal_score) AS esg_linguistic_credibility_index,
               1 - least({pop_std_sql(['policy_specificity_score', 'regulatory_readiness_score', 'commitment_credibility_score', 'narrative_credibility_index', 'ev', '1 - greenwashing_signal_score'])} * 2, 1) AS credibility_confidence_interval,
               (regulatory_readiness_score + commitment_credibility_score) / 2 AS policy_temporal_alignment,
               {mean_sql(['1 - greenwashing_signal_score', 'narrative_credibility_index', 'commitment_credibility_score', 'policy_specificity_score', '1 - promotional_dominance_score', 'progress_to_promise_ratio'])}
                 * (1 - least({pop_std_sql(['1 - greenwashing_signal_score', 'narrative_credibility_index', 'commitment_credibility_score', 'policy_specificity_score', '1 - promotional_dominance_score', 'progress_to_promise_ratio'])}, 1)) AS narrative_consistency_score
        FROM nlp3"""),
    "nlp": (("nlp4",), """
        SELECT *, least(greatest(100 * (0.5 * esg_linguistic_credibility_index + 0.3 * (1 - multi_signal_greenwashing_score) + 0.2 * narrative_consistency_score), 0), 100) AS aggregate_esg_nlp_score
        FROM nlp4"""),
})

# ---------------------------------------------------------------- labels and scores
IND = {"gw_indicator_1": "esg_controversy_divergence", "gw_indicator_2": "greenwashing_signal_score",
       "gw_indicator_4": "controversy_risk_ratio", "gw_indicator_5": "combined_anomaly_score"}
SUM5 = " + ".join(f"gw_indicator_{i}" for i in range(1, 6))


def minmax_sql(c: str, source: str) -> str:
    return f"({c} - (SELECT min({c}) FROM {source})) / ((SELECT max({c}) FROM {source}) - (SELECT min({c}) FROM {source})) * 100"


CTES.update({
    "inputs": (("num", "bins", "nlp2"), """
        SELECT num.company_id, num.company_name, num.sector, num.industry, num.source, num.total_esg_risk_score, num.controversy_score,
               env_risk_score, social_risk_score, gov_risk_score, pillar_imbalance_score, esg_controversy_divergence, controversy_risk_ratio,
               combined_anomaly_score, risk_controversy_mismatch, greenwashing_signal_score, vague_language_count, hedge_language_count,
               concrete_evidence_count, text_polarity
        FROM num JOIN (SELECT company_id, risk_controversy_mismatch FROM bins) USING (company_id)
        JOIN (SELECT company_id, greenwashing_signal_score, vague_language_count, hedge_language_count, concrete_evidence_count, text_polarity FROM nlp2) USING (company_id)"""),
    "flags": (("inputs",), "SELECT *, " + ", ".join(
        f"CASE WHEN {c} > (SELECT quantile_cont({c}, 0.75) FROM inputs) THEN 1 ELSE 0 END AS {f}" for f, c in IND.items())
        + ", risk_controversy_mismatch AS gw_indicator_3 FROM inputs"),
    "labelled": (("flags",), f"""
        SELECT *, {SUM5} AS gw_proxy_score, CASE WHEN {SUM5} >= 2 THEN 1 ELSE 0 END AS gw_label_binary,
               CASE WHEN {SUM5} <= 1 THEN 0 WHEN {SUM5} <= 3 THEN 1 ELSE 2 END AS gw_label_multiclass FROM flags"""),
    "comps": (("labelled",), f"""
        SELECT *, gw_proxy_score / 5.0 * 100 AS comp_proxy, greatest(least(greenwashing_signal_score * 100, 100), 0) AS comp_linguistic,
               {minmax_sql('esg_controversy_divergence', 'labelled')} AS comp_divergence, 50.0::DOUBLE AS comp_credibility_inv,
               {minmax_sql('controversy_risk_ratio', 'labelled')} AS comp_controversy_ratio FROM labelled"""),
    "scored": (("comps",), f"""
        SELECT *, CASE WHEN risk_score <= 20 THEN 'Very Low Risk' WHEN risk_score <= 40 THEN 'Low Risk' WHEN risk_score <= 60 THEN 'Moderate Risk'
                       WHEN risk_score <= 80 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_tier
        FROM (SELECT *, least(greatest(CAST(round_even(0.4 * comp_proxy + 0.15 * comp_linguistic + 0.15 * comp_divergence
                        + 0.15 * comp_credibility_inv + 0.15 * comp_controversy_ratio, 2) AS DOUBLE), 0), 100) AS risk_score FROM comps)"""),
})
