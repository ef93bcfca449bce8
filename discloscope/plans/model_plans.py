"""Model evaluation, training, attribution, what-if and live operators as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from discloscope.functions.exprs import with_globals
from discloscope.operators import attribution as X
from discloscope.operators import evaluation as E
from discloscope.operators import training as TR
from discloscope.plans.cleaning_plans import clean_companies, scratch
from discloscope.plans.feature_plans import scored
from discloscope.plans.registry import CTES, case_map, cte, query, text
from discloscope.plans.text_plans import cmp_sql  # noqa: F401  (registers the live-headline CTE)
from discloscope.session import materialize
from discloscope.sources import adapters as A
from discloscope.streaming import live as L

HASH = "(((id % 2147483648)::HUGEINT * 2654435761 + 42) % 4294967296)"


@query("stratified_split", cte(f"""
    SELECT id, y, CASE WHEN r < floor(n * 0.6::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT id, y, rank() OVER (PARTITION BY y ORDER BY {HASH}) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM pred)""", "pred"))
def stratified_split(spark, sf):
    p = A.predictions(spark, sf).select("id", "y")
    return E.stratified_split(p, "id", "y", {"train": 0.6, "val": 0.2, "test": 0.2})


@query("balanced_weights", cte("SELECT id, y, count(*) OVER () / (SELECT count(DISTINCT y) FROM pred) / count(*) OVER (PARTITION BY y) AS weight FROM pred", "pred"), "weight")
def balanced_weights(spark, sf):
    return E.balanced_weights(A.predictions(spark, sf).select("id", "y"), "y")


CTES["ranked"] = (("pred_long",), """
    SELECT *, rank() OVER (PARTITION BY model, split ORDER BY p) + (count(*) OVER (PARTITION BY model, split, p) - 1) / 2.0 AS rk, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h,
           -CASE WHEN y = 1 THEN ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))) ELSE ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))) END AS ll FROM pred_long""")
CTES["conf"] = (("ranked",), """
    SELECT model, split, count(*) AS n_samples, count(*) FILTER (WHERE h = 0 AND y = 0) AS tn, count(*) FILTER (WHERE h = 1 AND y = 0) AS fp,
           count(*) FILTER (WHERE h = 0 AND y = 1) AS fn, count(*) FILTER (WHERE h = 1 AND y = 1) AS tp, avg(ll) AS log_loss, sum(rk) FILTER (WHERE y = 1) AS rs,
           sum(y) AS np FROM ranked GROUP BY model, split""")
CTES["metrics"] = (("conf",), """
    SELECT model, split, n_samples, tn, fp, fn, tp, log_loss, (tp + tn) / n_samples AS accuracy,
           (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
           coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
           coalesce(tn / nullif(tn + fn, 0), 0) AS npv, (rs - np * (np + 1) / 2.0) / nullif(np * (n_samples - np), 0) AS roc_auc,
           coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp)::DOUBLE * (tn + fn)), 0), 0) AS mcc FROM conf""")
MET = ["log_loss", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "mcc"]


def metrics(spark, sf):
    return E.classification_metrics(A.predictions_long(spark, sf))


COLS = ["model", "split", "n_samples", "tn", "fp", "fn", "tp", *MET]


@query("classification_metrics", cte(f"SELECT {', '.join(COLS)} FROM metrics", "metrics"), " ".join(MET))
def classification_metrics(spark, sf):
    return metrics(spark, sf).select(*COLS)


@query("specificity_npv", cte("SELECT model, split, specificity, npv FROM metrics", "metrics"), "specificity npv")
def specificity_npv(spark, sf):
    return metrics(spark, sf).select("model", "split", "specificity", "npv")


@query("roc_pr_curves", cte("""
    SELECT model, p AS threshold, sum(tp) OVER w / sum(tp) OVER m AS tpr, (sum(n) OVER w - sum(tp) OVER w) / (sum(n) OVER m - sum(tp) OVER m) AS fpr, sum(tp) OVER w / sum(n) OVER w AS precision
    FROM (SELECT model, p, count(*) AS n, sum(y) AS tp FROM pred_long GROUP BY model, p)
    WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m AS (PARTITION BY model)""", "pred_long"), "threshold tpr fpr precision")
def roc_pr_curves(spark, sf):
    return E.curve_points(A.predictions_long(spark, sf))


@query("average_precision", cte("""
    SELECT model, sum(tp / tot * (ctp / cn)) AS average_precision FROM (
        SELECT model, tp, sum(tp) OVER (PARTITION BY model) AS tot, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn
        FROM (SELECT model, p, count(*) AS n, sum(y) AS tp FROM pred_long GROUP BY model, p) WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    GROUP BY model""", "pred_long"), "average_precision")
def average_precision(spark, sf):
    return E.average_precision(A.predictions_long(spark, sf))


LL = "-avg(CASE WHEN y = 1 THEN ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, a * p1 + (1 - a) * p2))) ELSE ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, a * p1 + (1 - a) * p2))) END)"


@query("blend_weight_search", cte(f"SELECT arg_min(a, loss) AS alpha, min(loss) AS loss FROM (SELECT a, {LL} AS loss FROM (SELECT * FROM pred WHERE split = 'val'), (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS a) GROUP BY a)", "pred"), "alpha loss")
def blend_weight_search(spark, sf):
    return E.best_blend(A.predictions(spark, sf).filter("split = 'val'"))


@query("soft_vote", cte("SELECT id, (p1 + p2 + p3) / 3 AS vote, CASE WHEN (p1 + p2 + p3) / 3 >= 0.5 THEN 1 ELSE 0 END AS vote_class FROM pred", "pred"), "vote")
def soft_vote(spark, sf):
    return E.soft_vote(A.predictions(spark, sf), ["p1", "p2", "p3"]).select("id", "vote", "vote_class")


@query("cv_summary", cte("""
    , r AS (SELECT *, id % 5 AS fold, rank() OVER (PARTITION BY model, id % 5 ORDER BY p) + (count(*) OVER (PARTITION BY model, id % 5, p) - 1) / 2.0 AS rk,
                   CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM pred_long),
    f AS (SELECT model, fold, avg(CASE WHEN h = y THEN 1.0 ELSE 0 END) AS acc, coalesce(2 * sum(h * y) / nullif(sum(h) + sum(y), 0), 0) AS f1,
                 (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY model, fold)
    SELECT model, avg(acc) AS accuracy_mean, stddev_pop(acc) AS accuracy_std, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std, avg(auc) AS roc_auc_mean, stddev_pop(auc) AS roc_auc_std
    FROM f GROUP BY model""", "pred_long"), "accuracy_mean accuracy_std f1_mean f1_std roc_auc_mean roc_auc_std")
def cv_summary(spark, sf):
    folds = E.classification_metrics(A.predictions_long(spark, sf).withColumn("fold", F.col("id") % 5), ["model", "fold"])
    return E.cv_summary(folds, ["accuracy", "f1", "roc_auc"])


@query("leaderboard", cte("SELECT split, model, roc_auc, CAST(row_number() OVER (PARTITION BY split ORDER BY roc_auc DESC, model) AS INTEGER) AS rank FROM metrics", "metrics"), "roc_auc")
def leaderboard(spark, sf):
    return E.leaderboard(metrics(spark, sf), "roc_auc")


@query("overfit_gap", cte("""
    SELECT *, CASE WHEN gap > 0.15 THEN 'OVERFITTING' WHEN gap > 0.05 THEN 'mild overfit' WHEN gap < -0.05 THEN 'underfit?' ELSE 'OK' END AS status
    FROM (SELECT model, max(f1) FILTER (WHERE split = 'train') AS train_f1, max(f1) FILTER (WHERE split = 'test') AS test_f1,
                 max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'test') AS gap FROM metrics GROUP BY model)""", "metrics"), "train_f1 test_f1 gap")
def overfit_gap(spark, sf):
    return E.overfit_gap(metrics(spark, sf))


RUNS = 20


# the resampling half below has no SQL form; this is its aggregation half
@query("bootstrap_summary", cte(f"""
    SELECT id, avg(p) AS mc_mean, stddev_pop(p) AS mc_std, quantile_cont(p, 0.025) AS ci_low, quantile_cont(p, 0.975) AS ci_high
    FROM (SELECT id, least(1, p1 + ((id * 31 + r * 17) % 41) / 400.0) AS p FROM pred, (SELECT unnest(range(0, {RUNS})) AS r)) GROUP BY id""", "pred"), "mc_mean mc_std ci_low ci_high")
def bootstrap_summary(spark, sf):
    return E.summarize_array(resampled(A.predictions(spark, sf), "id"), "ps").drop("ps")


def resampled(predictions, *keep):
    """Scores of ``RUNS`` models a row, as resampling would give them."""
    each = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.least(F.lit(1.0), F.col("p1") + ((F.col("id") * 31 + r * 17) % 41) / 400.0))
    return predictions.select(*keep, each.alias("ps"))


RESAMPLES = f"(SELECT id, least(1, p1 + ((id * 31 + r * 17) % 41) / 400.0) AS p FROM pred, (SELECT unnest(range(0, {RUNS})) AS r))"


@query("predictions_table", cte(f"""
    SELECT id, y, split, p1, p2, 0.2 * p1 + 0.8 * p2 AS blend, CASE WHEN 0.2 * p1 + 0.8 * p2 >= 0.5 THEN 1 ELSE 0 END AS predicted, mc_std AS uncertainty, mc_mean, ci_low, ci_high,
           CASE WHEN mc_std < 0.05 THEN 'stable' WHEN mc_std < 0.15 THEN 'moderate' ELSE 'manual review' END AS band, coalesce(s.gw_proxy_score, 0) AS gw_proxy_score
    FROM pred JOIN (SELECT id, avg(p) AS mc_mean, stddev_pop(p) AS mc_std, quantile_cont(p, 0.025) AS ci_low, quantile_cont(p, 0.975) AS ci_high FROM {RESAMPLES} GROUP BY id) USING (id)
    LEFT JOIN labelled s ON s.company_id = id""", "pred", "labelled"), "p1 p2 blend uncertainty mc_mean ci_low ci_high")
def predictions_table(spark, sf):
    """Scores, blend, summary of the resampled models, its band, and the proxy score of the company."""
    from discloscope.operators.rules import uncertainty_band
    blend = F.col("p1") * 0.2 + F.col("p2") * 0.8
    told = E.summarize_array(resampled(A.predictions(spark, sf), "id", "y", "split", "p1", "p2"), "ps")
    proxies = scored(spark, sf).select(F.col("company_id").alias("id"), "gw_proxy_score")
    return told.join(proxies, "id", "left").select(
        "id", "y", "split", "p1", "p2", blend.alias("blend"), (blend >= 0.5).cast("int").alias("predicted"), F.col("mc_std").alias("uncertainty"),
        "mc_mean", "ci_low", "ci_high", uncertainty_band(F.col("mc_std")).alias("band"), F.coalesce("gw_proxy_score", F.lit(0)).alias("gw_proxy_score"))


# ------------------------------------------------------------------ attribution
CTES["attr"] = (("clean",), " UNION ALL ".join(
    f"SELECT company_id, '{c}' AS feature, {c} AS value, {w} * ({c} - avg({c}) OVER ()) AS attribution FROM clean" for c, w in A.COEFFICIENTS.items()))


def attribution(spark, sf):
    return X.linear_attribution(materialize(clean_companies(spark, sf).select("company_id", *A.NUMERIC_FEATURES)), A.COEFFICIENTS)


@query("linear_attribution", cte("SELECT * FROM attr", "attr"), "value attribution")
def linear_attribution(spark, sf):
    return attribution(spark, sf)


@query("mean_abs_importance", cte("SELECT feature, avg(abs(attribution)) AS importance FROM attr GROUP BY feature", "attr"), "importance")
def mean_abs_importance(spark, sf):
    return X.mean_abs_importance(attribution(spark, sf))


@query("top_contributors", cte("""
    SELECT company_id, total, CAST(rn AS INTEGER) AS feature_rank, feature, attribution, CASE WHEN round(attribution, 9) > 0 THEN 'INCREASES' ELSE 'DECREASES' END AS direction,
           CASE WHEN abs(attribution) > 0.1 THEN 'strong' WHEN abs(attribution) > 0.05 THEN 'medium' ELSE 'weak' END AS strength
    FROM (SELECT a.*, total, row_number() OVER (PARTITION BY company_id ORDER BY abs(attribution) DESC, feature) AS rn
          FROM attr a JOIN (SELECT company_id, sum(attribution) AS total FROM attr GROUP BY company_id ORDER BY total DESC, company_id LIMIT 10) USING (company_id)) WHERE rn <= 10""", "attr"), "total attribution")
def top_contributors(spark, sf):
    return X.top_contributors(attribution(spark, sf))


@query("attribution_summary", cte("""
    SELECT company_id, sum(attribution) AS net, sum(CASE WHEN attribution > 0 THEN attribution ELSE 0 END) AS positive_sum, sum(CASE WHEN attribution < 0 THEN attribution ELSE 0 END) AS negative_sum,
           count(*) FILTER (WHERE attribution > 0) AS n_positive, count(*) FILTER (WHERE attribution < 0) AS n_negative FROM (SELECT company_id, round(attribution, 9) AS attribution FROM attr) GROUP BY company_id""", "attr"), "net positive_sum negative_sum")
def attribution_summary(spark, sf):
    return X.attribution_summary(attribution(spark, sf))


IMP = "SELECT feature, avg(abs(attribution)) AS importance FROM attr GROUP BY feature"
IMP2 = "SELECT feature, stddev_pop(attribution) AS importance FROM attr GROUP BY feature"


@query("blended_importance", cte(f"""
    SELECT feature, a.importance / ((SELECT max(importance) FROM ({IMP})) + 1e-10) AS first, b.importance / ((SELECT max(importance) FROM ({IMP2})) + 1e-10) AS second,
           0.2 * a.importance / ((SELECT max(importance) FROM ({IMP})) + 1e-10) + 0.8 * b.importance / ((SELECT max(importance) FROM ({IMP2})) + 1e-10) AS blended
    FROM ({IMP}) a JOIN ({IMP2}) b USING (feature)""", "attr"), "first second blended")
def blended_importance(spark, sf):
    a = attribution(spark, sf)
    return E.blended_importance(X.mean_abs_importance(a), a.groupBy("feature").agg(F.stddev_pop("attribution").alias("importance")), 0.2)


CAT = " ".join(f"WHEN {' OR '.join(f'contains(feature, {text(k)})' for k in parts)} THEN '{label}'" for label, parts in E.FAMILIES)


@query("feature_category_map", cte(f"SELECT feature, CASE {CAT} ELSE 'Other' END AS category, importance / sum(importance) OVER () * 100 AS importance_pct FROM ({IMP})", "attr"), "importance_pct")
def feature_category_map(spark, sf):
    imp = X.mean_abs_importance(attribution(spark, sf))
    whole = imp.agg(F.sum("importance").alias("s")).scalar()
    return imp.select("feature", E.feature_category(F.col("feature")).alias("category"), (F.col("importance") / whole * 100.0).alias("importance_pct"))


@query("attribution_category_summary", cte(f"""
    SELECT category, count(*) AS n_features, avg(importance) AS mean_importance, max(importance) AS max_importance, CAST(min(rk) AS INTEGER) AS best_rank
    FROM (SELECT feature, importance, CASE {CAT} ELSE 'Other' END AS category, row_number() OVER (ORDER BY importance DESC, feature) AS rk FROM ({IMP})) GROUP BY category""", "attr"), "mean_importance max_importance")
def attribution_category_summary(spark, sf):
    from pyspark.sql import Window
    # one row per feature
    imp = X.mean_abs_importance(attribution(spark, sf)).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return imp.groupBy(E.feature_category(F.col("feature")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("importance").alias("mean_importance"), F.max("importance").alias("max_importance"), F.min("rk").alias("best_rank"))


# ------------------------------------------------------------------ training
FEATURES = ["total_esg_risk_score", "env_risk_score", "social_risk_score", "gov_risk_score", "controversy_score", "pillar_imbalance_score",
            "vague_language_count", "hedge_language_count", "concrete_evidence_count", "text_polarity"]


def training_rows(spark, sf):
    """Clean feature rows with label, split and fold, staged once."""
    df = scored(spark, sf).withColumn("label", F.col("gw_label_binary").cast("double"))
    rows = TR.prepare(df, FEATURES, ["company_id", "label"])
    sizes = E.label_sizes(rows, "company_id", "label")
    rows = E.stratified_split(rows, "company_id", "label", {"train": 0.8, "test": 0.2}, sizes=sizes)
    rows = E.balanced_weights(rows, "label", sizes)
    return materialize(rows.withColumn("fold", (E.split_hash(F.col("company_id"), 7) % 5).cast("int")))


def fitted(spark, sf, name, weight="weight"):
    rows = training_rows(spark, sf)
    model = TR.pipeline(TR.estimators(weight=weight)[name], FEATURES).fit(rows.filter("split = 'train'"))
    return rows, model


CTES["training"] = (("labelled",), f"""
    SELECT *, CASE WHEN rank() OVER (PARTITION BY label ORDER BY {HASH.replace("id ", "company_id ")}) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT company_id, CAST(gw_label_binary AS DOUBLE) AS label, {", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in FEATURES)} FROM labelled)""")


@query("feature_select", "SELECT unnest([" + ", ".join(text(c) for c in (
    "total_esg_risk_score controversy_score env_risk_score social_risk_score gov_risk_score pillar_imbalance_score "
    "vague_language_count hedge_language_count concrete_evidence_count text_polarity comp_proxy comp_linguistic comp_divergence "
    "comp_credibility_inv comp_controversy_ratio risk_score").split()) + "]) AS feature")
def feature_select(spark, sf):
    names = TR.select_features(scored(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("standardize_train_only", cte("SELECT company_id, split, " + ", ".join(
    f"coalesce(({f} - avg({f}) FILTER (split = 'train') OVER ()) / nullif(stddev_samp({f}) FILTER (split = 'train') OVER (), 0), 0) AS {f}" for f in FEATURES)
    + " FROM training", "training"), " ".join(FEATURES))
def standardize_train_only(spark, sf):
    from pyspark.ml.functions import vector_to_array
    rows, model = fitted(spark, sf, "logistic_regression")
    out = model.transform(rows).select("company_id", "split", vector_to_array("features").alias("v"))
    return out.select("company_id", "split", *[F.get("v", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])


FAMILIES = ["decision_tree", "gradient_boosting", "linear_margin", "logistic_regression", "random_forest"]


@query("fitted_model_checks", cte("""
    SELECT family, n_rows, n_train, TRUE AS labels_only, TRUE AS beats_majority
    FROM (SELECT unnest([""" + ", ".join(text(f) for f in FAMILIES) + """]) AS family), (SELECT count(*) AS n_rows, count(*) FILTER (split = 'train') AS n_train FROM training)""", "training"))
def fitted_model_checks(spark, sf):
    """What holds for every fitted family whatever its numbers: rows, labels, and balanced accuracy on the training rows above a constant guess."""
    rows, out = training_rows(spark, sf), None
    for family in FAMILIES:
        model = TR.pipeline(TR.estimators(weight="weight")[family], FEATURES).fit(rows.filter("split = 'train'"))
        train, hit = F.col("split") == "train", (F.col("prediction") == F.col("label")).cast("int")
        recalls = [F.avg(F.when(train & (F.col("label") == y), hit)) for y in (0, 1)]
        checks = model.transform(rows).agg(
            F.lit(family).alias("family"), F.count(F.lit(1)).alias("n_rows"), F.count_if(train).alias("n_train"),
            F.min(F.col("prediction").isin(0.0, 1.0)).alias("labels_only"), (recalls[0] + recalls[1] > 1.0).alias("beats_majority"))
        out = checks if out is None else out.unionByName(checks)
    return out


@query("isolation_forest_checks", cte("SELECT count(*) AS n_rows, TRUE AS in_range, TRUE AS share_kept, TRUE AS flags_on_top FROM training", "training"))
def isolation_forest_checks(spark, sf):
    """Scores lie between 0 and 1, at most the wanted share is flagged, and every flagged row scores above every other."""
    score, flag = F.col("anomaly_score"), F.col("is_anomaly") == 1
    return TR.isolation_forest(training_rows(spark, sf), FEATURES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min((score > 0) & (score < 1)).alias("in_range"),
        (F.count_if(flag) <= F.ceil(F.count(F.lit(1)) * 0.15)).alias("share_kept"), (F.min(F.when(flag, score)) > F.max(F.when(~flag, score))).alias("flags_on_top"))


def model_query(name, family):
    @query(name)
    def run(spark, sf):
        rows, model = fitted(spark, sf, family)
        return model.transform(rows).select("company_id", "split", "label", "prediction")
    return run


model_query("random_forest", "random_forest")
model_query("gradient_boosting", "gradient_boosting")
model_query("logistic_regression", "logistic_regression")
model_query("linear_margin", "linear_margin")
model_query("decision_tree", "decision_tree")


#: folds of the search
FOLDS = 3
FOLD_HASH = HASH.replace("id ", "company_id ").replace("+ 42", "+ 7")


@query("search_folds", cte(f"""
    SELECT company_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {FOLD_HASH}, company_id) - 1) % {FOLDS} AS INTEGER) AS fold
    FROM training WHERE split = 'train'""", "training"))
def search_folds(spark, sf):
    return E.stratified_folds(training_rows(spark, sf).filter("split = 'train'"), "company_id", "label", FOLDS).select("company_id", "label", "fold")


@query("grid_search_cv")
def grid_search_cv(spark, sf):
    """Every point with its score over the folds; the best one, refitted on all training rows, with its score on the test rows."""
    rows = materialize(E.stratified_folds(training_rows(spark, sf).drop("fold"), "company_id", "label", FOLDS))
    search = TR.grid_search(rows.filter("split = 'train'"), FEATURES, weight="weight", folds=FOLDS)
    hits = F.count_if((F.col("prediction") == 1) & (F.col("label") == 1))
    tested = search.model.transform(rows.filter("split = 'test'")).agg(
        F.coalesce(2.0 * hits / F.nullif(F.count_if(F.col("prediction") == 1) + F.count_if(F.col("label") == 1), F.lit(0)), F.lit(0.0)).alias("f1")).first()["f1"]
    order = sorted(range(len(search.points)), key=lambda i: (-search.points[i][2], i))
    out = [(*search.points[i], rank, i == search.best, tested if i == search.best else None) for rank, i in enumerate(order, 1)]
    return spark.createDataFrame(out, "family string, point string, mean_f1 double, std_f1 double, rank int, chosen boolean, test_f1 double")


def monitored(spark, sf, name):
    """Rows in three parts, and a boosted model that the middle part stops."""
    rows = E.stratified_split(training_rows(spark, sf).drop("split"), "company_id", "label", {"train": 0.6, "val": 0.2, "test": 0.2})
    rows = materialize(rows.withColumn("held", F.col("split") == "val"))
    return rows, TR.monitored_boosting(rows.filter("split <> 'test'"), FEATURES, TR.estimators()[name], "held")


@query("gradient_boosting_slow")
def gradient_boosting_slow(spark, sf):
    """The second configuration, stopped by its validation rows; every row with the rounds that were kept."""
    rows, model = monitored(spark, sf, "gradient_boosting_slow")
    return model.transform(rows).select("company_id", "split", "label", "prediction", F.lit(model.stages[-1].getNumTrees).alias("rounds"))


@query("boosting_rounds")
def boosting_rounds(spark, sf):
    """Loss on the validation rows after every kept round of both configurations."""
    out = []
    for name in ("gradient_boosting", "gradient_boosting_slow"):
        rows, model = monitored(spark, sf, name)
        out += [(name, i, float(loss)) for i, loss in enumerate(TR.staged_losses(model, rows.filter("split = 'val'")), 1)]
    return spark.createDataFrame(out, "family string, round int, validation_loss double")


@query("feature_importance")
def feature_importance(spark, sf):
    _, model = fitted(spark, sf, "random_forest")
    return TR.feature_importance(model, FEATURES, spark)


@query("bootstrap_uncertainty")
def bootstrap_uncertainty(spark, sf):
    rows = training_rows(spark, sf)
    est = TR.estimators(weight="weight")["logistic_regression"]
    drawn = TR.bootstrap_predictions(rows.filter("split = 'train'"), rows, FEATURES, est, RUNS)
    return E.summarize_array(drawn, "ps").drop("ps")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return TR.isolation_forest(training_rows(spark, sf), FEATURES)


@query("knn_vote", """
    SELECT id, label AS predicted FROM (
        SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS v FROM (
            SELECT id, label, count(*) AS votes FROM (
                SELECT q.vec_id AS id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY
                    list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE))), t.vec_id) AS rn
                FROM embeddings q JOIN embeddings t ON q.vec_id % 5 = 4 AND t.vec_id % 5 <> 4) WHERE rn <= 5 GROUP BY id, label)) WHERE v = 1""")
def knn_vote(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    near = TR.nearest_neighbours(e.filter("id % 5 <> 4"), e.filter("id % 5 = 4"))
    return TR.knn_vote(near)


@query("tree_attribution")
def tree_attribution(spark, sf):
    rows = training_rows(spark, sf)
    model = TR.pipeline(TR.estimators()["gradient_boosting"], FEATURES, standardize=False).fit(rows.filter("split = 'train'"))
    return X.tree_attribution(rows, model.stages[-1], FEATURES)


@query("tree_attribution_checks", cte(f"SELECT count(*) AS n_rows, {len(FEATURES)} * count(*) AS n_attributions, TRUE AS adds_up FROM training", "training"))
def tree_attribution_checks(spark, sf):
    """Base and attributions of every row add up to the margin of the boosted trees."""
    from pyspark.ml.functions import vector_to_array
    rows = training_rows(spark, sf)
    model = TR.pipeline(TR.estimators()["gradient_boosting"], FEATURES, standardize=False).fit(rows.filter("split = 'train'"))
    parts = X.tree_attribution(rows, model.stages[-1], FEATURES).groupBy("company_id").agg(
        (F.first("base") + F.sum("attribution")).alias("total"), F.count(F.lit(1)).alias("n"))
    margins = model.transform(rows).select("company_id", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"))
    return margins.join(parts, "company_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_attributions"),
                                                 (F.max(F.abs(F.col("total") - F.col("margin"))) < 1e-9).alias("adds_up"))


def most_important(model, spark, most=15):
    """Features of a fitted model by importance, the largest first."""
    ranked = TR.feature_importance(model, FEATURES, spark).orderBy(F.desc("importance"), "feature").limit(most)
    return [r["feature"] for r in ranked.collect()]  # at most ``most`` names


@query("counterfactual_search")
def counterfactual_search(spark, sf):
    rows, model = fitted(spark, sf, "logistic_regression")
    return X.counterfactuals(rows.select("company_id", *FEATURES), model, FEATURES, most_important(model, spark))


@query("what_if_scenarios")
def what_if_scenarios(spark, sf):
    rows, model = fitted(spark, sf, "logistic_regression")
    scenarios = {"calm": {"controversy_score": 1.0}, "scandal": {"controversy_score": 5.0, "total_esg_risk_score": 10.0}}
    return X.what_if(rows.select("company_id", *FEATURES), model, FEATURES, scenarios)


@query("sensitivity_sweep")
def sensitivity_sweep(spark, sf):
    rows, model = fitted(spark, sf, "logistic_regression")
    return X.sensitivity(rows.select("company_id", *FEATURES), model, FEATURES, most_important(model, spark))


# ------------------------------------------------------------------ live articles
REF = dt.datetime(2024, 2, 1)
AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(published)) / 3.6e9"


def articles(spark, sf):
    return A.articles(A.table(spark, sf, "events"))


def base_risk(spark, sf):
    t = A.table(spark, sf, "part").select(F.col("p_partkey").alias("company_id"), F.least(F.lit(100.0), F.col("p_size") * 2.0).alias("base_risk"))
    return t


CTES["base_risk"] = ((), "SELECT p_partkey AS company_id, least(100.0::DOUBLE, p_size * 2.0) AS base_risk FROM part")
CTES["windowed"] = (("live",), """
    SELECT company_id, time_bucket(INTERVAL '1 day', published) AS window_start,
           avg(sentiment * exp(-(epoch_us(time_bucket(INTERVAL '1 day', published) + INTERVAL '1 day') - epoch_us(published)) / 3.6e9 / 72)) AS mean_weighted, count(*) AS n_articles
    FROM live GROUP BY 1, 2""")
CTES["edelta"] = (("live",), f"""
    SELECT company_id, CAST(round_even(-15 * avg(sentiment * exp(-{AGE} / 72)), 1) AS DOUBLE) AS delta, count(*) AS n_articles FROM live GROUP BY company_id""")


@query("recency_weight", cte(f"SELECT article_id, {AGE} AS hours, exp(-{AGE} / 72) AS weight FROM articles", "articles"), "hours weight")
def recency_weight(spark, sf):
    h = L.age_hours(F.col("published"), F.lit(REF))
    return articles(spark, sf).select("article_id", h.alias("hours"), L.recency_weight(h).alias("weight"))


@query("age_label", cte(f"SELECT article_id, CASE WHEN h < 1 THEN CAST(floor(h * 60) AS BIGINT) || 'm ago' WHEN h < 24 THEN CAST(floor(h) AS BIGINT) || 'h ago' ELSE CAST(floor(h / 24) AS BIGINT) || 'd ago' END AS age FROM (SELECT article_id, {AGE} AS h FROM articles)", "articles"))
def age_label(spark, sf):
    return articles(spark, sf).select("article_id", L.age_label(L.age_hours(F.col("published"), F.lit(REF))).alias("age"))


@query("live_sentiment_delta", cte("""
    SELECT company_id, window_start, mean_weighted, n_articles, base_risk, delta, greatest(0, least(100, base_risk + delta)) AS new_risk
    FROM (SELECT *, CAST(round_even(-15 * mean_weighted, 1) AS DOUBLE) AS delta FROM windowed) JOIN base_risk USING (company_id)""", "windowed", "base_risk"), "mean_weighted base_risk delta new_risk")
def live_sentiment_delta(spark, sf):
    out = L.live_risk(L.windowed_sentiment(L.score_articles(articles(spark, sf))), base_risk(spark, sf))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("alert_status", cte("SELECT company_id, delta, CASE WHEN delta > 5 THEN 'ALERT' WHEN delta > 2 THEN 'WATCH' WHEN delta < -2 THEN 'IMPROVED' ELSE 'STABLE' END AS status FROM edelta", "edelta"), "delta")
def alert_status(spark, sf):
    d = L.entity_delta(L.score_articles(articles(spark, sf)), REF).withColumn("delta", L.risk_delta(F.col("mean_weighted")))
    return d.select("company_id", "delta", L.alert_status(F.col("delta")).alias("status")).orderBy(F.desc("delta"), "company_id")


@query("sentiment_class_counts", cte("""
    SELECT time_bucket(INTERVAL '1 day', published) AS window_start, CASE WHEN sentiment < -0.1 THEN 'negative' WHEN sentiment > 0.1 THEN 'positive' ELSE 'neutral' END AS sentiment_class, count(*) AS n
    FROM live GROUP BY 1, 2""", "live"))
def sentiment_class_counts(spark, sf):
    s = L.score_articles(articles(spark, sf))
    return s.groupBy(F.window("published", "1 day").alias("w"), L.sentiment_class(F.col("sentiment")).alias("sentiment_class")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "sentiment_class", "n")


@query("article_timeline", cte("SELECT article_id, company_id, published, title, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY company_id, url ORDER BY published, article_id) AS rn FROM live) WHERE rn = 1", "live"), "sentiment")
def article_timeline(spark, sf):
    """First delivery of every article of a company, in time order."""
    a = A.deliveries(articles(spark, sf))
    first = a.groupBy("company_id", "url").agg(F.min_by(F.struct("article_id", "published", "title"), F.struct("published", "article_id")).alias("r"))
    return L.score_articles(first.select("company_id", "r.*")).select(
        "article_id", "company_id", F.col("published").cast("timestamp_ntz").alias("published"), "title", "sentiment").orderBy("published", "article_id")


#: slices of the events in which they land, and how late an article or its repeat may come
SLICES, LATE = 6, "3 days"


#: rows of a slice that are worth a file, and so a reading task, of their own
FILE_ROWS = 10_000


def land(events, folder, n):
    """Writes the slices of ``events`` in order of time, ``n`` files each; returns the files of every slice."""
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    files = []
    for i in range(SLICES):
        lo, hi = (ends["lo"] + (ends["hi"] - ends["lo"]) * (i + j) / SLICES for j in (0, 1))
        inside = (F.col("ts") >= lo) & ((F.col("ts") < hi) if i < SLICES - 1 else F.lit(True))
        events.filter(inside).repartition(n).write.parquet(f"{folder}/{i}")
        files.append(len(events.sparkSession.read.parquet(f"{folder}/{i}").inputFiles()))
    return files


def landed(spark, sf):
    """The events as a stream of files that land in order of time; the feed delivers some of them twice.

    A micro-batch has to be one slice: rows of a slice that came after its newest ones would be late. So all slices have
    the same number of files, one each if a slice is too small to fill more.
    """
    events = A.table(spark, sf, "events")
    most = min(4 * spark.sparkContext.defaultParallelism, events.count() // (SLICES * FILE_ROWS))
    for n in ([most, 1] if most > 1 else [1]):
        folder = scratch(spark)
        files = land(events, folder, n)
        if set(files) == {n}:
            break
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", n).parquet(folder)
    return A.deliveries(A.articles(stream))


def replayed(spark, sf):
    """Folder of the changes that a run over all landed events has written."""
    changes, busy = scratch(spark), L.busy_companies(articles(spark, sf))
    L.incremental_scoring(landed(spark, sf), changes, scratch(spark), LATE, busy).awaitTermination()
    return changes


STATE_SQL = """
    SELECT company_id, count(*) AS n, sum(sentiment * exp(-(epoch_us(newest) - epoch_us(published)) / 3.6e9 / 72)) / count(*) AS mean_weighted, newest AS as_of
    FROM (SELECT *, max(published) OVER (PARTITION BY company_id) AS newest FROM live) GROUP BY company_id, newest"""


@query("incremental_scoring", cte(STATE_SQL, "live"), "mean_weighted")
def incremental_scoring(spark, sf):
    """Replays the events as a stream of files and returns the final per-company state."""
    out = L.latest_state(spark, replayed(spark, sf))
    return out.select("company_id", "n", (F.col("weighted_sum") / F.col("n")).alias("mean_weighted"), F.col("as_of").cast("timestamp_ntz").alias("as_of"))


@query("alert_stream", cte(f"""
    SELECT company_id, n, as_of, delta, CASE WHEN delta > 5 THEN 'ALERT' WHEN delta > 2 THEN 'WATCH' WHEN delta < -2 THEN 'IMPROVED' ELSE 'STABLE' END AS status
    FROM (SELECT *, CAST(round_even(-15 * mean_weighted, 1) AS DOUBLE) AS delta FROM ({STATE_SQL}))""", "live"), "delta")
def alert_stream(spark, sf):
    """The latest status of every company after a run over all landed events."""
    return L.latest_alerts(spark, replayed(spark, sf)).withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query("timeline_stream", cte("SELECT article_id, company_id, published, title, sentiment FROM live", "live"), "sentiment")
def timeline_stream(spark, sf):
    """Every article once, as a running stream has appended it."""
    folder = scratch(spark)
    L.timeline_stream(landed(spark, sf), folder, scratch(spark), LATE).awaitTermination()
    return spark.read.parquet(folder).select("article_id", "company_id", F.col("published").cast("timestamp_ntz").alias("published"), "title", "sentiment")
