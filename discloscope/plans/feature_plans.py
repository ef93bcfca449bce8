"""Feature packs, labels and scores as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloscope.functions.exprs import with_globals
from discloscope.operators import categorical as K
from discloscope.operators import labels as L
from discloscope.operators import nlp as N
from discloscope.operators import numeric as M
from discloscope.operators.cleaning import median_impute as median_impute_rows
from discloscope.plans import sql_features as S
from discloscope.plans.cleaning_plans import clean_companies
from discloscope.plans.registry import cte, query
from discloscope.session import materialize
from discloscope.sources import adapters as A

INT_FEATURES = {"env_dominance_flag", "esg_iqr_outlier", "controversy_iqr_outlier", "sector_rank", *K.FEATURES["risk_bins"],
                *K.FEATURES["cross"], *K.FEATURES["issues"], "sector_frequency", "industry_frequency", "sector_company_count",
                "total_word_count", "unique_word_count", "dominant_keyword_pillar", "sentence_count", "question_mark_count",
                "exclamation_count"} - {"controversy_bin", "risk_controversy_gap"}


def doubles_of(cols):
    return " ".join(c for c in cols if c not in INT_FEATURES and not c.endswith(("_count", "_segment")))


def pack_query(name, cols, source, build):
    @query(name, cte(f"SELECT company_id, {', '.join(cols)} FROM {source}", source), doubles_of(cols))
    def run(spark, sf):
        return build(spark, sf).select("company_id", *cols)
    return run


def num_base(spark, sf):
    return clean_companies(spark, sf)


pack_query("pillar_ratios", M.FEATURES["pillar_ratios"], "num2", lambda s, d: M.pillar_ratios(num_base(s, d)))
pack_query("risk_decomposition", M.FEATURES["risk_decomposition"], "num2", lambda s, d: M.risk_decomposition(M.pillar_ratios(num_base(s, d))))
pack_query("statistical_moments", M.FEATURES["statistical_moments"], "num3", lambda s, d: M.statistical_moments(num_base(s, d)))
pack_query("interactions", M.FEATURES["interactions"], "num3",
           lambda s, d: M.interactions(M.statistical_moments(M.pillar_ratios(num_base(s, d)))))
pack_query("anomaly", M.FEATURES["anomaly"], "num", lambda s, d: M.anomaly(M.statistical_moments(num_base(s, d))))
pack_query("group_zscore", ["esg_sector_mean", "esg_sector_std", "esg_vs_sector_mean", "esg_sector_zscore", "controversy_vs_sector"],
           "num", lambda s, d: M.group_zscores(num_base(s, d)))
pack_query("group_rank_min", ["sector_rank"], "num", lambda s, d: M.group_ranks(num_base(s, d)))
pack_query("group_percentile", ["sector_percentile"], "num", lambda s, d: M.group_ranks(num_base(s, d)))


@query("all_numeric", cte(f"""
    , q AS (SELECT {', '.join(f"quantile_cont(coalesce(CAST({f} AS DOUBLE), 0), [0.25, 0.5, 0.75]) AS {f}" for f in M.ALL_FEATURES)} FROM num)
    SELECT company_id, {', '.join(f"num.{f}" for f in M.ALL_FEATURES)}, {', '.join(
        f"(coalesce(CAST(num.{f} AS DOUBLE), 0) - q.{f}[2]) / (CASE WHEN q.{f}[3] = q.{f}[1] THEN 1 ELSE q.{f}[3] - q.{f}[1] END) AS {f}_scaled"
        for f in M.ALL_FEATURES)} FROM num, q""", "num"), doubles_of(M.ALL_FEATURES) + " " + " ".join(f"{f}_scaled" for f in M.ALL_FEATURES))
def all_numeric(spark, sf):
    return M.all_numeric(materialize(num_base(spark, sf))).select("company_id", *M.ALL_FEATURES, *[f"{f}_scaled" for f in M.ALL_FEATURES])


pack_query("risk_bins", K.FEATURES["risk_bins"], "bins", lambda s, d: K.risk_bins(num_base(s, d)))
pack_query("cross_features", [*K.FEATURES["cross"], "esg_controversy_segment"], "cat",
           lambda s, d: K.cross_features(K.risk_bins(num_base(s, d))))
pack_query("frequency_encode", K.FEATURES["frequency"], "cat", lambda s, d: K.frequency_encode(A.companies(s, d)))
pack_query("issue_flags", K.FEATURES["issues"], "cat", lambda s, d: K.issue_flags(A.material_issues(A.companies(s, d))))
pack_query("all_categorical", K.ALL_FEATURES, "cat", lambda s, d: K.all_categorical(materialize(A.material_issues(num_base(s, d)))))

SCALED = ["total_esg_risk_score", "controversy_score", "env_risk_score"]


@query("scaling", cte("SELECT company_id, " + ", ".join(
    f"(coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM profile)) / (SELECT stddev_pop(coalesce({c}, 0)) FROM profile) AS {c}_standard, "
    f"(coalesce({c}, 0) - (SELECT min(coalesce({c}, 0)) FROM profile)) / (SELECT max(coalesce({c}, 0)) - min(coalesce({c}, 0)) FROM profile) AS {c}_minmax, "
    f"(coalesce({c}, 0) - (SELECT quantile_cont(coalesce({c}, 0), 0.5) FROM profile)) / (SELECT quantile_cont(coalesce({c}, 0), 0.75) - quantile_cont(coalesce({c}, 0), 0.25) FROM profile) AS {c}_robust"
    for c in SCALED) + " FROM profile", "profile"), " ".join(f"{c}_{m}" for c in SCALED for m in ("standard", "minmax", "robust")))
def scaling(spark, sf):
    df = A.companies(spark, sf).select("company_id", *SCALED)
    for m in ("standard", "minmax", "robust"):
        df = M.scale(df, SCALED, m).withColumnsRenamed({f"{c}_scaled": f"{c}_{m}" for c in SCALED})
    return df.select("company_id", *[f"{c}_{m}" for c in SCALED for m in ("standard", "minmax", "robust")])


GRID = [round(-2 + 0.25 * i, 2) for i in range(25)]


@query("scaling_power", f"""
    WITH g AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in GRID)}]) AS lam),
    t AS (SELECT p_partkey AS company_id, lam, x, CASE WHEN lam = 0 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END AS y
          FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * (CASE WHEN p_partkey % 97 = 0 THEN 4 ELSE 1 END) AS x FROM part), g),
    best AS (SELECT arg_max(lam, ll) AS lam FROM (SELECT lam, -count(*) / 2 * ln(var_pop(y)) + (lam - 1) * sum(ln(1 + x)) AS ll FROM t GROUP BY lam))
    SELECT company_id, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS total_esg_risk_score_scaled FROM t JOIN best USING (lam)""", "total_esg_risk_score_scaled")
def scaling_power(spark, sf):
    df = A.companies(spark, sf).select("company_id", "total_esg_risk_score")
    return M.power_scale(df, ["total_esg_risk_score"], rounds=1).select("company_id", "total_esg_risk_score_scaled")


# ------------------------------------------------------------------ text packs
def text_base(spark, sf):
    return N.prepare(A.profile(spark, sf).select("company_id", "description"))


pack_query("polarity_pack", N.FEATURES["polarity"], "nlp1", lambda s, d: N.polarity_pack(text_base(s, d)))
pack_query("readability_pack", N.FEATURES["readability"], "nlp1", lambda s, d: N.readability_pack(text_base(s, d)))
pack_query("vocabulary_pack", N.FEATURES["vocabulary"], "nlp1", lambda s, d: N.vocabulary_pack(text_base(s, d)))
pack_query("keyword_pack", N.FEATURES["keyword"], "nlp2", lambda s, d: N.keyword_pack(text_base(s, d)))
pack_query("linguistic_pack", N.FEATURES["linguistic"], "nlp2", lambda s, d: N.linguistic_pack(text_base(s, d)))
pack_query("structure_pack", N.FEATURES["structure"], "nlp2", lambda s, d: N.structure_pack(text_base(s, d)))
pack_query("policy_pack", N.FEATURES["policy"], "nlp3", lambda s, d: N.policy_pack(text_base(s, d)))
pack_query("intent_pack", N.FEATURES["intent"], "nlp3", lambda s, d: N.intent_pack(N.polarity_pack(text_base(s, d))))
pack_query("temporal_pack", N.FEATURES["temporal"], "nlp3", lambda s, d: N.temporal_pack(text_base(s, d)))
pack_query("aggregate_pack", N.FEATURES["aggregate"], "nlp", lambda s, d: N.all_nlp(A.profile(s, d).select("company_id", "description")))
pack_query("all_nlp", N.ALL_FEATURES, "nlp", lambda s, d: N.all_nlp(A.profile(s, d).select("company_id", "description")))


# ------------------------------------------------------------------ labels and scores
INPUTS = ["company_id", "company_name", "sector", "industry", "source", "total_esg_risk_score", "controversy_score", *M.PILLARS,
          "pillar_imbalance_score", "esg_controversy_divergence", "controversy_risk_ratio", "combined_anomaly_score",
          "risk_controversy_mismatch", "greenwashing_signal_score", "vague_language_count", "hedge_language_count",
          "concrete_evidence_count", "text_polarity"]


TEXT_INPUTS = ["greenwashing_signal_score", "vague_language_count", "hedge_language_count", "concrete_evidence_count", "text_polarity"]


def population(spark, sf):
    """Label and score inputs, staged once, and the number of companies.

    Two rounds of figures over the narrow scan come first (medians, quartiles and moments; then deviations), so every
    other step is row by row. Texts are read once, straight from the scan, and leave five numbers a company.
    """
    plain = A.companies(spark, sf)
    known, rows = M.known_figures(plain, {p: {"p50": 0.5} for p in M.PILLARS})
    df = median_impute_rows(plain, M.PILLARS, medians=known).transform(M.pillar_ratios).transform(M.risk_decomposition)
    df = df.transform(M.statistical_moments, moments=known).transform(M.anomaly, with_rank=False, robust=known)
    df = df.transform(K.risk_bins).withColumn("risk_controversy_mismatch", K.mismatch_flag())
    texts = N.linguistic_pack(N.polarity_pack(N.prepare(A.profile(spark, sf).select("company_id", "description")))).select("company_id", *TEXT_INPUTS)
    return materialize(df.join(texts, "company_id").select(*INPUTS)), rows


def score_inputs(spark, sf):
    return population(spark, sf)[0]


def labelled(spark, sf):
    """Inputs with proxy labels, and the population figures that components need too."""
    df, rows = population(spark, sf)
    known = L.score_figures(df, rows)
    return L.proxy_labels(df, known), known


def scored(spark, sf):
    """Scores with everything that led to them: a projection of the staged inputs under one round of figures."""
    df, known = labelled(spark, sf)
    return L.final_score(L.component_scores(df, known))


LABELS = [*[f"gw_indicator_{i}" for i in range(1, 6)], "gw_proxy_score", "gw_label_binary", "gw_label_multiclass"]
COMPONENTS = list(L.WEIGHTS)


@query("proxy_labels", cte(f"SELECT company_id, {', '.join(LABELS)} FROM labelled", "labelled"))
def proxy_labels(spark, sf):
    return labelled(spark, sf)[0].select("company_id", *LABELS)


@query("component_scores", cte(f"SELECT company_id, {', '.join(COMPONENTS)} FROM comps", "comps"), " ".join(COMPONENTS))
def component_scores(spark, sf):
    return L.component_scores(*labelled(spark, sf)).select("company_id", *COMPONENTS)


@query("final_score_tier", cte("SELECT company_id, risk_score, risk_tier FROM scored", "scored"), "risk_score")
def final_score_tier(spark, sf):
    return scored(spark, sf).select("company_id", "risk_score", "risk_tier")


@query("risk_leaderboard", cte("""
    SELECT company_name, sector, risk_score, risk_tier, sector_mean, sector_n
    FROM (SELECT *, avg(risk_score) OVER (PARTITION BY sector) AS sector_mean, count(*) OVER (PARTITION BY sector) AS sector_n FROM scored)
    ORDER BY risk_score DESC, company_name LIMIT 20""", "scored"), "risk_score sector_mean")
def risk_leaderboard(spark, sf):
    from discloscope.functions.ranking import attach_group
    df = scored(spark, sf).select("company_name", "sector", "risk_score", "risk_tier")
    top = df.orderBy(F.desc("risk_score"), "company_name").limit(20)
    by_sector = df.groupBy("sector").agg(F.avg("risk_score").alias("sector_mean"), F.count(F.lit(1)).alias("sector_n"))
    return attach_group(top, by_sector, ["sector"])


@query("scenario_indicator_score", cte("""
    SELECT company_id, factor, ((CASE WHEN esg_controversy_divergence * factor > (SELECT quantile_cont(esg_controversy_divergence, 0.75) FROM inputs) THEN 1 ELSE 0 END)
        + (CASE WHEN greenwashing_signal_score * factor > (SELECT quantile_cont(greenwashing_signal_score, 0.75) FROM inputs) THEN 1 ELSE 0 END)
        + gw_indicator_3 + gw_indicator_4 + gw_indicator_5) / 5.0 * 100 AS scenario_score
    FROM flags, (SELECT unnest([0.5::DOUBLE, 0.9, 1.1]) AS factor)""", "flags"), "factor scenario_score")
def scenario_indicator_score(spark, sf):
    df = score_inputs(spark, sf)
    moved = df.withColumn("factor", F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(1.1)))).withColumns({
        "esg_controversy_divergence": F.col("esg_controversy_divergence") * F.col("factor"),
        "greenwashing_signal_score": F.col("greenwashing_signal_score") * F.col("factor")})
    return L.scenario_score(moved, L.thresholds(df)).select("company_id", "factor", "scenario_score")
