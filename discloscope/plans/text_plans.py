"""Text functions, claims, sentiment and helper expressions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions import text as X
from discloscope.functions.exprs import argmax, eps_ratio, normalized_entropy, row_mean, row_std, soft_bound, squash
from discloscope.operators import documents as D
from discloscope.operators import sentiment as E
from discloscope.plans.registry import CTES, case_map, cte, query, text, text_list
from discloscope.plans.sql_features import count_sql, entropy_sql, in_count_sql, mean_sql, pieces_sql, pop_std_sql, strip_sql, words_sql
from discloscope.session import materialize
from discloscope.sources import adapters as A

SP = X.SPACE
HTML = "regexp_replace(description, '<[^\\n]*?>', '', 'g')"


def urls_sql(t):
    return f"regexp_replace({t}, 'https?://{X.NON_SPACE}+|www\\.{X.NON_SPACE}+', '', 'g')"


def charset_sql(t):
    return f"regexp_replace({t}, '[^a-zA-Z0-9.,\\-{SP[1:]}', '', 'g')"


def numbers_sql(t):
    return f"regexp_replace({t}, '\\b\\d+\\.?\\d*\\b', '', 'g')"


def space_sql(t):
    return f"trim(regexp_replace({t}, '{SP}+', ' ', 'g'))"


CLEAN = space_sql(numbers_sql(charset_sql(f"lower({urls_sql(HTML)})")))


def scalar(name, expr, sql):
    @query(name, cte(f"SELECT doc_id, {sql} AS out FROM corpus", "corpus"))
    def run(spark, sf):
        return A.corpus(spark, sf).select("doc_id", expr(F.col("description")).alias("out"))
    return run


scalar("strip_html", X.strip_html, HTML)
scalar("strip_urls", X.strip_urls, urls_sql("description"))
scalar("keep_charset", X.keep_charset, charset_sql("description"))
# ASCII word edges on the SQL side, so the check runs on text reduced to that set
scalar("strip_numbers", lambda c: X.strip_numbers(X.keep_charset(c)), numbers_sql(charset_sql("description")))
scalar("collapse_space", lambda c: F.lower(X.collapse_space(c)), f"lower({space_sql('description')})")
scalar("clean_text", X.clean, CLEAN)

KEPT_STOP = [w for w in V.STOPWORDS if w not in V.PROTECTED]
CTES["cleaned"] = (("corpus",), f"SELECT doc_id, {CLEAN} AS clean_text FROM corpus")
NO_STOP = f"array_to_string(list_filter({words_sql('clean_text')}, lambda w: NOT list_contains({text_list(KEPT_STOP)}, w)), ' ')"


@query("remove_stopwords", cte(f"SELECT doc_id, {NO_STOP} AS out FROM cleaned", "cleaned"))
def remove_stopwords(spark, sf):
    return A.corpus(spark, sf).select("doc_id", D.remove_stopwords(X.clean(F.col("description"))).alias("out"))


def stats_sql(col, prefix=""):
    w, n = words_sql(col), f"len({words_sql(col)})"
    s = f"len(list_filter(string_split_regex({col}, '[.!?]+'), lambda s: {strip_sql('s')} <> ''))"

    def share(x):
        return f"CASE WHEN {n} = 0 THEN 0 ELSE CAST(round_even({x} / {n}, 3) AS DOUBLE) END"
    return (f"CAST({n} AS INTEGER) AS {prefix}word_count, CAST(length({col}) AS INTEGER) AS {prefix}char_count, "
            f"{share(f'list_sum(list_transform({w}, lambda x: length(x)))')} AS {prefix}avg_word_length, "
            f"CAST(CASE WHEN {col} = '' THEN 0 ELSE greatest({s}, 1) END AS INTEGER) AS {prefix}sentence_count, "
            f"CASE WHEN {col} = '' THEN 0 ELSE CAST(round_even({n} / greatest({s}, 1), 3) AS DOUBLE) END AS {prefix}avg_sentence_length, "
            f"{share(f'len(list_distinct({w}))')} AS {prefix}unique_word_ratio, "
            f"{share(f'len(list_filter({w}, lambda x: length(x) >= 8))')} AS {prefix}long_word_ratio")


STAT_DOUBLES = ["avg_word_length", "avg_sentence_length", "unique_word_ratio", "long_word_ratio"]
STATS = ["word_count", "char_count", "avg_word_length", "sentence_count", "avg_sentence_length", "unique_word_ratio", "long_word_ratio"]


@query("text_statistics", cte(f"SELECT doc_id, {stats_sql('description')} FROM corpus", "corpus"), " ".join(STAT_DOUBLES))
def text_statistics(spark, sf):
    return D.with_statistics(A.corpus(spark, sf), "description").select("doc_id", *STATS)


@query("preprocess_frame", cte(f"SELECT doc_id, clean_text, {NO_STOP} AS clean_text_no_stopwords, {stats_sql('clean_text', 'clean_')} FROM cleaned", "cleaned"),
       " ".join("clean_" + d for d in STAT_DOUBLES))
def preprocess_frame(spark, sf):
    out = D.preprocess(A.corpus(spark, sf), "description")
    return out.select("doc_id", "clean_text", "clean_text_no_stopwords", *[f"clean_{s}" for s in STATS])


@query("phrase_count", cte(f"SELECT doc_id, {count_sql('lower(description)', V.CONCRETE)} AS hits, {count_sql('lower(description)', V.HEDGE)} AS hedges FROM corpus", "corpus"))
def phrase_count(spark, sf):
    low = A.corpus(spark, sf).select("doc_id", F.lower("description").alias("t"))
    out = low.withColumn("h", X.phrase_counts(F.col("t"), {"concrete": V.CONCRETE, "hedge": V.HEDGE}))
    return out.select("doc_id", F.col("h.concrete").alias("hits"), F.col("h.hedge").alias("hedges"))


KW = {"env": V.PILLAR_ENVIRONMENTAL, "social": V.PILLAR_SOCIAL, "gov": V.PILLAR_GOVERNANCE}


def per100(x):
    return f"CASE WHEN n > 0 THEN CAST(round_even({x} / n * 100, 3) AS DOUBLE) ELSE 0 END"


@query("pillar_keywords", cte(f"""
    SELECT doc_id, e AS env_keyword_count, s AS social_keyword_count, g AS gov_keyword_count, {per100('e')} AS env_keyword_density,
           {per100('s')} AS social_keyword_density, {per100('g')} AS gov_keyword_density, e + s + g AS total_esg_keyword_count,
           {per100('(e + s + g)')} AS esg_keyword_density,
           CASE WHEN e + s + g = 0 THEN 'none' WHEN e >= s AND e >= g THEN 'environmental' WHEN s >= g THEN 'social' ELSE 'governance' END AS dominant_esg_pillar
    FROM (SELECT doc_id, {count_sql('t', KW['env'])} AS e, {count_sql('t', KW['social'])} AS s, {count_sql('t', KW['gov'])} AS g, len({words_sql('t')}) AS n
          FROM (SELECT doc_id, lower(description) AS t FROM corpus))""", "corpus"),
       "env_keyword_density social_keyword_density gov_keyword_density esg_keyword_density")
def pillar_keywords(spark, sf):
    return D.pillar_keywords(A.corpus(spark, sf).select("doc_id", "description"), "description").drop("description")


# ------------------------------------------------------------------ sentences and claims
def guarded_sql(t):
    # RE2 has no look-behind: keep the character before the abbreviation as a group
    out = t
    for a in V.ABBREVIATIONS:
        out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){a}\\.', '\\1{a}<PERIOD>', 'gi')"
    return out


CTES["sents"] = (("corpus",), f"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, l[i] AS sentence, lower(l[i]) AS low
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({guarded_sql('description')}, '([.!?]){SP}+([A-Z])', '\\1<SPLIT>\\2', 'g'), '<SPLIT>'),
               lambda s: {strip_sql("replace(s, '<PERIOD>', '.')")}), lambda s: length(s) >= 10) AS l FROM corpus))""")


def any_rx(col, patterns):
    return "(" + " OR ".join(f"regexp_matches({col}, {text(p)})" for p in patterns) + ")"


def any_in(col, terms):
    return "(" + " OR ".join(f"contains({col}, {text(t)})" for t in terms) + ")"


def points(test, w):
    return f"(CASE WHEN {test} THEN {w}::DOUBLE ELSE 0 END)"


STRENGTH = "least(" + " + ".join([points(any_rx("low", V.QUANTITY_PATTERNS), 0.3), points(any_rx("low", [V.TIMEFRAME_PATTERN]), 0.2),
                                  points(any_in("low", V.VERIFICATION), 0.2), points(any_in("low", V.ACTION_VERBS), 0.15),
                                  points(any_rx("low", [V.COMPARISON_PATTERN]), 0.15)]) + ", 1.0)"
FIRST = "CASE " + " ".join(f"WHEN regexp_matches(low, {text(p[1])}) THEN {i}" for i, p in enumerate(V.CLAIM_PATTERNS)) + " END"
MATCHED = "CASE p " + " ".join(f"WHEN {i} THEN regexp_extract(low, {text(p[1])}, 0)" for i, p in enumerate(V.CLAIM_PATTERNS)) + " END"


def pick(i):
    return f"{text_list([p[i] for p in V.CLAIM_PATTERNS])}[p + 1]"


CTES["claims"] = (("sents",), f"""
    SELECT doc_id, sentence_no, sentence, {pick(0)} AS pattern_name, {pick(2)} AS pillar, {pick(3)} AS claim_type, {pick(4)} AS claim_description,
           {MATCHED} AS matched_text, {STRENGTH} AS strength_score, {any_in('low', V.VERIFICATION)} AS has_verification,
           CASE WHEN {any_in('low', V.CLAIM_PAST)} THEN 'past' WHEN {any_in('low', V.CLAIM_FUTURE)} THEN 'future' ELSE 'unspecified' END AS temporal
    FROM (SELECT *, {FIRST} AS p FROM sents) WHERE p IS NOT NULL""")


@query("sentence_split", cte("SELECT doc_id, sentence_no, sentence FROM sents", "sents"))
def sentence_split(spark, sf):
    return D.sentence_rows(A.corpus(spark, sf), "doc_id", "description")


def claims(spark, sf):
    return D.extract_claims(A.corpus(spark, sf), "doc_id", "description")


CLAIM_COLS = ["doc_id", "sentence_no", "sentence", "pattern_name", "pillar", "claim_type", "claim_description", "matched_text"]


@query("claim_extract", cte(f"SELECT {', '.join(CLAIM_COLS)} FROM claims", "claims"))
def claim_extract(spark, sf):
    return claims(spark, sf).select(*CLAIM_COLS)


@query("claim_strength", cte("SELECT doc_id, sentence_no, strength_score, has_verification FROM claims", "claims"), "strength_score")
def claim_strength(spark, sf):
    return claims(spark, sf).select("doc_id", "sentence_no", "strength_score", "has_verification")


@query("claim_temporal", cte("SELECT doc_id, sentence_no, temporal FROM claims", "claims"))
def claim_temporal(spark, sf):
    return claims(spark, sf).select("doc_id", "sentence_no", "temporal")


def sh(test):
    return f"count(*) FILTER (WHERE {test}) / count(*)"


CRED = "0.3 * ver + 0.25 * past + 0.25 * av + 0.1 * cred + 0.1 * (claim_pillar_diversity / 3.0)"
RATIOS = {"avg_claim_strength": "av", "verified_claim_ratio": "ver", "past_claim_ratio": "past", "future_claim_ratio": "fut",
          "performance_claim_ratio": "perf", "target_claim_ratio": "tar", "credential_claim_ratio": "cred", "strong_claim_ratio": "strong",
          "weak_claim_ratio": "weak", "claim_credibility_score": CRED}
LONGS = ["total_claims", "env_claims", "social_claims", "gov_claims", "claim_pillar_diversity"]
CTES["claim_metrics"] = (("claims",), f"""
    SELECT doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in LONGS)},
           {', '.join(f'coalesce(CAST(round_even({e}, 4) AS DOUBLE), 0) AS {n}' for n, e in RATIOS.items())}
    FROM corpus LEFT JOIN (SELECT doc_id, count(*) AS total_claims, count(*) FILTER (WHERE pillar = 'Environmental') AS env_claims,
        count(*) FILTER (WHERE pillar = 'Social') AS social_claims, count(*) FILTER (WHERE pillar = 'Governance') AS gov_claims, avg(strength_score) AS av,
        {sh('has_verification')} AS ver, {sh("temporal = 'past'")} AS past, {sh("temporal = 'future'")} AS fut, {sh("claim_type = 'performance'")} AS perf,
        {sh("claim_type = 'target'")} AS tar, {sh("claim_type = 'credential'")} AS cred, count(DISTINCT pillar) AS claim_pillar_diversity,
        {sh('strength_score >= 0.5')} AS strong, {sh('strength_score < 0.3')} AS weak FROM claims GROUP BY doc_id) m USING (doc_id)""")


@query("claim_metrics", cte(f"SELECT doc_id, {', '.join(D.CLAIM_METRICS)} FROM claim_metrics", "claim_metrics"), " ".join(RATIOS))
def claim_metrics(spark, sf):
    docs = A.corpus(spark, sf)
    return D.claim_metrics(docs.select("doc_id"), claims(spark, sf), "doc_id").select("doc_id", *D.CLAIM_METRICS)


@query("extract_claims_frame", cte("SELECT doc_id, lang, source, total_claims, claim_credibility_score FROM corpus JOIN (SELECT doc_id, total_claims, claim_credibility_score FROM claim_metrics) USING (doc_id)", "claim_metrics"), "claim_credibility_score")
def extract_claims_frame(spark, sf):
    docs = A.corpus(spark, sf)
    return D.claim_metrics(docs.select("doc_id", "lang", "source"), D.extract_claims(docs, "doc_id", "description"), "doc_id") \
        .select("doc_id", "lang", "source", "total_claims", "claim_credibility_score")


@query("claim_report", cte("""
    SELECT 'pillar' AS dimension, pillar AS value, count(*) AS n, count(*) / (SELECT count(*) FROM claims) * 100 AS pct FROM claims GROUP BY 2
    UNION ALL SELECT 'claim_type', claim_type, count(*), count(*) / (SELECT count(*) FROM claims) * 100 FROM claims GROUP BY 2
    UNION ALL SELECT 'temporal', temporal, count(*), count(*) / (SELECT count(*) FROM claims) * 100 FROM claims GROUP BY 2
    UNION ALL BY NAME SELECT 'total' AS dimension, 'claims' AS value, count(*) AS n FROM claims
    UNION ALL BY NAME SELECT 'strength' AS dimension, unnest(['mean', 'median', 'std', 'min', 'max']) AS value,
        unnest([avg(strength_score), quantile_cont(strength_score, 0.5), stddev_samp(strength_score), min(strength_score), max(strength_score)]) AS strength_score
        FROM claims HAVING count(*) > 0
    UNION ALL BY NAME SELECT 'strongest' AS dimension, pillar AS value, strength_score, place AS position, doc_id, sentence_no, sentence FROM (SELECT *,
        CAST(row_number() OVER (ORDER BY strength_score DESC, doc_id NULLS FIRST, sentence_no, sentence, pillar) AS INTEGER) AS place FROM claims) WHERE place <= 10
    UNION ALL BY NAME SELECT 'weakest' AS dimension, pillar AS value, strength_score, place AS position, doc_id, sentence_no, sentence FROM (SELECT *,
        CAST(row_number() OVER (ORDER BY strength_score, doc_id NULLS FIRST, sentence_no, sentence, pillar) AS INTEGER) AS place FROM claims) WHERE place <= 10""", "claims"),
       "pct strength_score")
def claim_report(spark, sf):
    return D.claim_report(materialize(claims(spark, sf).select("doc_id", "sentence_no", "sentence", "pillar", "claim_type", "temporal", "strength_score")), "doc_id")


@query("claim_report_strength", cte("""
    SELECT count(*) AS total_claims, avg(strength_score) AS mean_strength, quantile_cont(strength_score, 0.5) AS median_strength, stddev_samp(strength_score) AS std_strength,
           min(strength_score) AS min_strength, max(strength_score) AS max_strength FROM claims""", "claims"),
       "mean_strength median_strength std_strength min_strength max_strength")
def claim_report_strength(spark, sf):
    return D.claim_strength_stats(materialize(claims(spark, sf).select("strength_score")))


@query("claim_report_extremes", cte("""
    (SELECT 'strongest' AS kind, doc_id, sentence_no, strength_score FROM claims ORDER BY strength_score DESC, doc_id, sentence_no LIMIT 10)
    UNION ALL (SELECT 'weakest', doc_id, sentence_no, strength_score FROM claims ORDER BY strength_score, doc_id, sentence_no LIMIT 10)""", "claims"), "strength_score")
def claim_report_extremes(spark, sf):
    c = materialize(claims(spark, sf).select("doc_id", "sentence_no", "strength_score"))
    top = c.orderBy(F.desc("strength_score"), "doc_id", "sentence_no").limit(10)
    low = c.orderBy("strength_score", "doc_id", "sentence_no").limit(10)
    return top.select(F.lit("strongest").alias("kind"), "*").unionByName(low.select(F.lit("weakest").alias("kind"), "*"))


VA, SU, FU, CO = (any_rx("lower(s)", p) for p in (V.REPORT_VAGUE, V.REPORT_SUPERLATIVE, V.REPORT_FUTURE, V.REPORT_CONCRETE))


def arms(a, b, c, d, e):
    return f"CASE WHEN va AND NOT co THEN '{a}' WHEN su THEN '{b}' WHEN fu AND NOT co THEN '{c}' WHEN co THEN '{d}' ELSE '{e}' END"


CTES["rep"] = (("corpus",), f"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, s AS claim_text, {arms('HIGH', 'MEDIUM', 'MEDIUM', 'LOW', 'MEDIUM')} AS risk_level,
           {arms('Uses vague language without measurable commitments', 'Superlative claims without supporting evidence', 'Future promise without past performance data',
                 'Contains measurable data points', 'Requires further verification')} AS issue,
           {arms('Vague Promise', 'Unverified', 'Vague Promise', 'Credible', 'Unverified')} AS evidence_type,
           CASE WHEN {any_in('lower(s)', V.REPORT_ENVIRONMENTAL)} THEN 'Environmental' WHEN {any_in('lower(s)', V.REPORT_SOCIAL)} THEN 'Social' ELSE 'Governance' END AS category
    FROM (SELECT doc_id, i, s, {VA} AS va, {SU} AS su, {FU} AS fu, {CO} AS co FROM (
        SELECT doc_id, i, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
            SELECT doc_id, {pieces_sql('description', 20)} AS l FROM corpus)))) WHERE va OR su OR fu OR co""")


@query("rule_report_claims", cte("SELECT * FROM rep", "rep"))
def rule_report_claims(spark, sf):
    return D.report_claims(A.corpus(spark, sf), "doc_id", "description")


@query("rule_report_analysis", cte("""
    SELECT doc_id, n_claims, n_high, overall_score, CASE WHEN overall_score >= 60 THEN 'HIGH' WHEN overall_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk,
           n_claims AS claims_shown, red_flags, positive_signals
    FROM (SELECT doc_id, coalesce(n, 0) AS n_claims, coalesce(h, 0) AS n_high, CAST(least(100, floor(coalesce(h, 0) / greatest(coalesce(n, 0), 1) * 100 + 20)) AS INTEGER) AS overall_score,
                 coalesce(rf, '') AS red_flags, coalesce(ps, '') AS positive_signals
          FROM corpus LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE risk_level = 'HIGH') AS h,
               array_to_string(list(issue ORDER BY sentence_no) FILTER (WHERE risk_level = 'HIGH'), '|') AS rf,
               array_to_string(list(issue ORDER BY sentence_no) FILTER (WHERE risk_level = 'LOW'), '|') AS ps FROM rep GROUP BY doc_id) USING (doc_id))""", "rep"))
def rule_report_analysis(spark, sf):
    docs = A.corpus(spark, sf)
    return D.report_summary(docs, D.report_claims(docs, "doc_id", "description"), "doc_id")


# ------------------------------------------------------------------ sentiment
def scores_sql(w):
    """List of non-zero token scores over a list expression ``w``."""
    pos, neg, boost = ("MAP {" + ", ".join(f"{text(k)}: {v}::DOUBLE" for k, v in m.items()) + "}" for m in (
        V.POSITIVE, {k: v for k, v in V.NEGATIVE.items() if k not in V.POSITIVE}, V.INTENSIFIERS))
    base = f"coalesce({pos}[{w}[i]], {neg}[{w}[i]], 0.0)"
    return (f"list_transform(range(1, len({w}) + 1), lambda i: {base} * CASE WHEN i > 1 THEN coalesce({boost}[{w}[i - 1]], 1.0) ELSE 1.0 END"
            f" * CASE WHEN i > 1 AND list_has_any({w}[greatest(i - 3, 1):i - 1], {text_list(V.NEGATIONS)}) THEN -0.75 ELSE 1.0 END)")


CTES["sw"] = (("corpus",), f"SELECT doc_id, lower(description) AS low, {words_sql('lower(description)')} AS w FROM corpus")
CTES["sent"] = (("sw",), f"SELECT *, {scores_sql('w')} AS sc FROM sw")


def cmp_sql(sc):
    s = f"coalesce(list_sum({sc}), 0.0)"
    return f"({s} / sqrt({s} * {s} + 15))"


CTES["vader"] = (("sent",), f"""
    SELECT doc_id, CAST(round_even({cmp_sql('sc')}, 4) AS DOUBLE) AS vader_compound, CAST(round_even(p, 4) AS DOUBLE) AS vader_positive,
           CAST(round_even(n, 4) AS DOUBLE) AS vader_negative, CAST(round_even(greatest(1 - p - n, 0), 4) AS DOUBLE) AS vader_neutral
    FROM (SELECT *, coalesce(list_sum(list_filter(sc, lambda x: x > 0)), 0) / m AS p, -coalesce(list_sum(list_filter(sc, lambda x: x < 0)), 0) / m AS n
          FROM (SELECT *, CASE WHEN coalesce(list_sum(list_transform(sc, lambda x: abs(x))), 0) = 0 THEN 1 ELSE list_sum(list_transform(sc, lambda x: abs(x))) END AS m FROM sent))""")
VADER = ["vader_compound", "vader_positive", "vader_negative", "vader_neutral"]


def sentiment_base(spark, sf):
    return E.prepare(A.corpus(spark, sf).select("doc_id", "description"), "description")


@query("lexicon_sentiment", cte(f"SELECT doc_id, {', '.join(VADER)} FROM vader", "vader"), " ".join(VADER))
def lexicon_sentiment(spark, sf):
    return E.lexicon_sentiment(sentiment_base(spark, sf)).select("doc_id", *VADER)


CTES["polsub"] = (("sw",), f"""
    SELECT doc_id, CASE WHEN p + n > 0 THEN CAST(round_even((p - n) / (p + n), 4) AS DOUBLE) ELSE 0 END AS polarity,
           CASE WHEN low = '' THEN 0 WHEN s + o > 0 THEN CAST(round_even(s / (s + o), 4) AS DOUBLE) ELSE 0.5 END AS subjectivity
    FROM (SELECT *, {in_count_sql('w', list(V.POSITIVE))} AS p, {in_count_sql('w', list(V.NEGATIVE))} AS n, {in_count_sql('w', V.SUBJECTIVE)} AS s,
                 {in_count_sql('w', V.OBJECTIVE)} AS o FROM sw)""")


@query("polarity_subjectivity", cte("SELECT doc_id, polarity, subjectivity FROM polsub", "polsub"), "polarity subjectivity")
def polarity_subjectivity(spark, sf):
    return E.polarity_subjectivity(sentiment_base(spark, sf)).select("doc_id", "polarity", "subjectivity")


SIG = list(E.SIGNALS)
CTES["ling"] = (("sw",), f"""
    SELECT doc_id, {', '.join(f'{k}_count' for k in SIG)}, {', '.join(f'CAST(round_even({k}_d, 3) AS DOUBLE) AS {k}_density' for k in SIG)},
           CASE WHEN low = '' THEN 0 ELSE CAST(round_even(1 / (1 + exp(-(vague_language_d + superlative_d + hedging_d + future_language_d - 2 * concrete_evidence_d) / 5)), 4) AS DOUBLE) END AS gw_linguistic_score
    FROM (SELECT *, {', '.join(f'CASE WHEN len(w) > 0 THEN {k}_count / len(w) * 100 ELSE 0 END AS {k}_d' for k in SIG)}
          FROM (SELECT *, {', '.join(f"{count_sql('low', t)} AS {k}_count" for k, t in E.SIGNALS.items())} FROM sw))""")
LING = [*[f"{k}_count" for k in SIG], *[f"{k}_density" for k in SIG], "gw_linguistic_score"]


@query("linguistic_detector", cte(f"SELECT doc_id, {', '.join(LING)} FROM ling", "ling"), " ".join(c for c in LING if not c.endswith("_count")))
def linguistic_detector(spark, sf):
    return E.linguistic_detector(sentiment_base(spark, sf)).select("doc_id", *LING)


def part_sql(i):
    return f"CASE WHEN len(w) < 15 THEN NULL ELSE w[{i} * (len(w) // 3) + 1 : {'len(w)' if i == 2 else f'{i + 1} * (len(w) // 3)'}] END"


CTES["sect"] = (("sw",), f"""
    SELECT doc_id, CASE WHEN len(w) < 15 THEN 0 ELSE CAST(round_even(v, 4) AS DOUBLE) END AS sentiment_variance,
           CASE WHEN len(w) < 15 THEN 0 ELSE CAST(round_even(greatest(c0, c1, c2) - least(c0, c1, c2), 4) AS DOUBLE) END AS sentiment_range,
           CASE WHEN len(w) < 15 THEN 1 ELSE CAST(round_even(1 - least(v * 10, 1), 4) AS DOUBLE) END AS sentiment_consistency
    FROM (SELECT *, {pop_std_sql(['c0', 'c1', 'c2'])} * {pop_std_sql(['c0', 'c1', 'c2'])} AS v FROM (
        SELECT doc_id, w, {', '.join(f"CAST(round_even({cmp_sql(scores_sql(f'w{i}'))}, 4) AS DOUBLE) AS c{i}" for i in range(3))}
        FROM (SELECT doc_id, w, {', '.join(f'{part_sql(i)} AS w{i}' for i in range(3))} FROM sw)))""")
SECT = ["sentiment_variance", "sentiment_range", "sentiment_consistency"]


@query("section_sentiment", cte(f"SELECT doc_id, {', '.join(SECT)} FROM sect", "sect"), " ".join(SECT))
def section_sentiment(spark, sf):
    return E.section_sentiment(sentiment_base(spark, sf)).select("doc_id", *SECT)


@query("sentiment_frame", cte(f"""
    SELECT doc_id, {', '.join(E.FEATURES)}, CASE WHEN vader_compound >= 0.3 THEN 'positive' WHEN vader_compound <= -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label
    FROM vader JOIN polsub USING (doc_id) JOIN ling USING (doc_id) JOIN sect USING (doc_id)""", "vader", "polsub", "ling", "sect"),
       " ".join(c for c in E.FEATURES if not c.endswith("_count")))
def sentiment_frame(spark, sf):
    return E.all_sentiment(A.corpus(spark, sf).select("doc_id", "description"), "description").select("doc_id", *E.FEATURES, "sentiment_label")


CTES["live"] = (("articles",), f"""
    SELECT *, CAST(round_even({cmp_sql(f"list_transform({words_sql('lower(title)')}, lambda w: coalesce(MAP {{{', '.join(f'{text(k)}: {v}::DOUBLE' for k, v in {**V.LIVE_NEGATIVE, **V.LIVE_POSITIVE}.items())}}}[regexp_replace(w, '[^a-z\\-]', '', 'g')], 0.0))")}, 4) AS DOUBLE) AS sentiment FROM articles""")


@query("live_headline_sentiment", cte("SELECT article_id, title, sentiment FROM live", "live"), "sentiment")
def live_headline_sentiment(spark, sf):
    a = A.articles(A.table(spark, sf, "events"))
    return a.select("article_id", "title", E.headline_sentiment(F.col("title")).alias("sentiment"))


@query("text_summary", cte(f"""
    SELECT avg(vader_compound) AS vader_compound_mean, stddev_samp(vader_compound) AS vader_compound_std, avg(subjectivity) AS subjectivity_mean,
           stddev_samp(subjectivity) AS subjectivity_std, avg(gw_linguistic_score) AS gw_linguistic_score_mean, stddev_samp(gw_linguistic_score) AS gw_linguistic_score_std
    FROM vader JOIN polsub USING (doc_id) JOIN ling USING (doc_id)""", "vader", "polsub", "ling"),
       "vader_compound_mean vader_compound_std subjectivity_mean subjectivity_std gw_linguistic_score_mean gw_linguistic_score_std", 4)
def text_summary(spark, sf):
    df = sentiment_base(spark, sf).transform(E.lexicon_sentiment).transform(E.polarity_subjectivity).transform(E.linguistic_detector)
    return df.agg(*[a.alias(n) for c in ("vader_compound", "subjectivity", "gw_linguistic_score")
                    for a, n in ((F.avg(c), f"{c}_mean"), (F.stddev_samp(c), f"{c}_std"))])


@query("lag_context", cte(f"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS word_no, w[i] AS word, w[i - 1] AS previous_word,
           CASE WHEN i > 1 THEN list_has_any(w[greatest(i - 3, 1):i - 1], {text_list(V.NEGATIONS)}) ELSE false END AS negated
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM sw) WHERE list_contains({text_list([*V.POSITIVE, *V.NEGATIVE])}, w[i])""", "sw"))
def lag_context(spark, sf):
    """Previous word and negation in the three words before, for every lexicon word; stays inside the row."""
    w = F.col("_w")
    ctx = F.transform(w, lambda x, i: F.struct(
        i.alias("word_no"), x.alias("word"), F.when(i > 0, F.get(w, i - 1)).alias("previous_word"),
        F.arrays_overlap(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), X.literal_array(V.NEGATIONS)).alias("negated")))
    hits = F.filter(ctx, lambda c: c["word"].isin([*V.POSITIVE, *V.NEGATIVE]))
    return sentiment_base(spark, sf).select("doc_id", F.explode(hits).alias("c")).select("doc_id", "c.*")


# ------------------------------------------------------------------ math, date and vector helpers
PT, PE, PS, PG = "total_esg_risk_score", "env_risk_score", "social_risk_score", "gov_risk_score"


@query("logistic_squash", cte(f"SELECT company_id, {', '.join(f'1 / (1 + exp(-{k} * (controversy_score - 3) / 10)) AS k{n}' for n, k in (('10', 10), ('15', 15), ('2', 2), ('5', 5), ('fifth', 0.2)))} FROM profile", "profile"), "k10 k15 k2 k5 kfifth")
def logistic_squash(spark, sf):
    x = (F.col("controversy_score") - 3) / 10.0
    return A.companies(spark, sf).select("company_id", *[squash(x, k).alias(f"k{n}") for n, k in (("10", 10.0), ("15", 15.0), ("2", 2.0), ("5", 5.0), ("fifth", 0.2))])


@query("normalized_entropy", cte(f"SELECT company_id, {entropy_sql([PT, PE, PS, PG])} AS entropy FROM profile WHERE env_risk_score IS NOT NULL", "profile"), "entropy")
def entropy(spark, sf):
    cols = [F.col(c) for c in (PT, PE, PS, PG)]
    return A.companies(spark, sf).filter(F.col(PE).isNotNull()).select("company_id", normalized_entropy(cols, cols[0] + cols[1] + cols[2] + cols[3]).alias("entropy"))


@query("soft_bound", cte(f"SELECT company_id, {PT} / sqrt({PT} * {PT} + 15) AS bounded FROM profile", "profile"), "bounded")
def soft_bound_query(spark, sf):
    return A.companies(spark, sf).select("company_id", soft_bound(F.col(PT)).alias("bounded"))


@query("epsilon_ratio", cte(f"SELECT company_id, controversy_score / ({PT} + 1e-8) AS ratio, ({PE} + 1e-8) / ({PG} + 1e-8) AS cross_ratio FROM profile", "profile"), "ratio cross_ratio", 4)
def epsilon_ratio(spark, sf):
    return A.companies(spark, sf).select("company_id", eps_ratio(F.col("controversy_score"), F.col(PT)).alias("ratio"),
                                       eps_ratio(F.col(PE) + 1e-8, F.col(PG)).alias("cross_ratio"))


@query("small_vector_stats", cte(f"""
    SELECT company_id, {mean_sql([PE, PS, PG])} AS mean, {pop_std_sql([PE, PS, PG])} AS std,
           CAST(CASE WHEN {PE} >= {PS} AND {PE} >= {PG} THEN 0 WHEN {PS} >= {PG} THEN 1 ELSE 2 END AS INTEGER) AS top,
           1 - least({pop_std_sql([PE, PS, PG])} / ({mean_sql([PE, PS, PG])} + 1e-8), 1) AS evenness FROM profile WHERE {PE} IS NOT NULL""", "profile"), "mean std evenness")
def small_vector_stats(spark, sf):
    v = [F.col(c) for c in (PE, PS, PG)]
    return A.companies(spark, sf).filter(F.col(PE).isNotNull()).select(
        "company_id", row_mean(v).alias("mean"), row_std(v, sample=False).alias("std"), argmax(v).alias("top"),
        (1.0 - F.least(eps_ratio(row_std(v, sample=False), row_mean(v)), F.lit(1.0))).alias("evenness"))
