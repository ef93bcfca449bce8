"""Splits, weights, metrics, curves, blending and leaderboards over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from discloscope.functions.exprs import total
from discloscope.functions.ranking import _join_keys, attach_group, figures, value_ranks

#: up to so many labels are handled as literals
MANY_LABELS = 64


def split_hash(key: Column, seed: int = 42) -> Column:
    """Integer mixing that any engine can repeat; ids that agree in their low 31 bits agree here."""
    return ((key % 2147483648) * 2654435761 + seed) % 4294967296


def _label_ranks(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds ``_rank`` from 0 inside each label by the hashed id, and by the id where hashes tie, and ``n``, the label's rows.

    Ranks come without a per-label window; the window over ties holds the few ids that agree in their low 31 bits.
    """
    hashed = df.withColumn("_h", split_hash(F.col(key), seed).cast("double"))
    ranked = _join_keys(hashed, value_ranks(hashed, [label], "_h"), [label, "_h"], "left")
    tie = F.row_number().over(Window.partitionBy(label, "_h").orderBy(key)) - 1
    return ranked.withColumn("_rank", F.col("below") + tie).drop("_h", "cnt", "below")


def label_sizes(df: DataFrame, key: str, label: str) -> list[Row] | None:
    """Rows and rows with a key of every label, or None beyond ``MANY_LABELS`` labels."""
    found = df.groupBy(F.col(label).alias("label")).agg(F.count(key).alias("n"), F.count(F.lit(1)).alias("rows")).limit(MANY_LABELS + 1).collect()
    return found if len(found) <= MANY_LABELS else None


def _label_cuts(hashed: DataFrame, label: str, sizes: list[Row], edges: Sequence[float]) -> list[list[float]] | None:
    """Per label the hash values that cut its rows at ``edges``; None where rows on both sides of a cut share their hash."""
    wanted: dict[str, dict[str, float]] = {}
    marked = hashed
    for i, s in enumerate(sizes):
        for j, edge in enumerate(edges):
            taken = math.floor(s["n"] * edge)
            if 0 < taken < s["n"]:
                # two values between the last row taken and the first one left; equal only if these two are
                wanted.setdefault(f"_h{i}", {}).update({f"{side}{j}": (taken - at) / (s["n"] - 1) for side, at in (("a", 0.75), ("b", 0.25))})
        if f"_h{i}" in wanted:
            marked = marked.withColumn(f"_h{i}", F.when(F.col(label).eqNullSafe(F.lit(s["label"])), F.col("_h")))
    known = figures(marked, wanted, rows=sum(s["rows"] for s in sizes)) if wanted else {}
    cuts = []
    for i, s in enumerate(sizes):
        row = []
        for j, edge in enumerate(edges):
            low, high = known.get(f"_h{i}_a{j}"), known.get(f"_h{i}_b{j}")
            if low is None:
                row.append(-1.0 if math.floor(s["n"] * edge) <= 0 else float("inf"))
            elif low == high:
                return None
            else:
                row.append((low + high) / 2.0)
        cuts.append(row)
    return cuts


def stratified_split(df: DataFrame, key: str, label: str, shares: dict[str, float], seed: int = 42, sizes: list[Row] | None = None) -> DataFrame:
    """Exact shares inside each label by rank of the hashed id; rows without an id go to the last part.

    The few hashes where a label's parts meet are selected as order statistics, so no row is shuffled. Very many labels,
    or ids that share their hash on both sides of a cut, are ranked instead. ``sizes``: the ``label_sizes`` where known.
    """
    names, edges = list(shares), []
    for name in names[:-1]:
        edges.append(shares[name] + (edges[-1] if edges else 0.0))
    sizes = label_sizes(df, key, label) if sizes is None else sizes
    hashed = df.withColumn("_h", split_hash(F.col(key), seed).cast("double"))
    cuts = _label_cuts(hashed, label, sizes, edges) if sizes else None
    if cuts is None:
        out = None
        for name, edge in zip(names, edges):
            test = F.col("_rank") < F.floor(F.col("n") * F.lit(edge))
            out = F.when(test, name) if out is None else out.when(test, name)
        return _label_ranks(df, key, label, seed).withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1])).drop("_rank", "n")
    split = F.lit(names[-1])
    for s, row in zip(sizes, cuts):
        part = F.lit(names[-1])
        for name, cut in reversed(list(zip(names, row))):
            part = F.when(F.col("_h") <= F.lit(cut), name).otherwise(part)
        split = F.when(F.col(label).eqNullSafe(F.lit(s["label"])), part).otherwise(split)
    return hashed.withColumn("split", split).drop("_h")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """Adds ``fold``: the ranks of every label are dealt out in turn, so that its rows per fold differ by one at most."""
    return _label_ranks(df, key, label, seed).withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank", "n")


def balanced_weights(df: DataFrame, label: str, sizes: list[Row] | None = None) -> DataFrame:
    """n / (classes * class size); a missing label has no weight. ``sizes``: the ``label_sizes`` where known."""
    sizes = label_sizes(df, label, label) if sizes is None else sizes
    if sizes is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
        whole = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"))
        row = whole.select((F.col("n") / F.col("k")).alias("r")).scalar()
        return attach_group(df, counts, [label]).withColumn("weight", row / F.col("_nc")).drop("_nc")
    share = sum(s["rows"] for s in sizes) / max(1, len(sizes))
    weight = F.lit(None).cast("double")
    for s in sizes:
        weight = F.when(F.col(label) == F.lit(s["label"]), F.lit(share / s["rows"])).otherwise(weight)
    return df.withColumn("weight", weight)


def log_loss(y: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q))


def classification_metrics(df: DataFrame, groups: Sequence[str] = ("model", "split"), y: str = "y", p: str = "p") -> DataFrame:
    """One row per group: confusion counts, rates, AUC from average ranks, clipped log-loss, MCC. Zero where undefined."""
    groups = list(groups)
    yc, hit = F.col(y), F.col(p) >= 0.5
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(hit & (yc == 1)).alias("tp"), F.count_if(hit & (yc == 0)).alias("fp"),
        F.count_if(~hit & (yc == 1)).alias("fn"), F.count_if(~hit & (yc == 0)).alias("tn"), F.avg(log_loss(yc, F.col(p))).alias("log_loss"))
    ranks = value_ranks(df, groups, p, {"pos": F.col(y).cast("long")})
    # sum over tied scores of positives * mean rank
    auc = ranks.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("cnt") + 1) / 2.0)).alias("_rank_sum"), F.max("n_pos").alias("_pos"), F.max("n").alias("_n"))
    out = base.join(auc, groups)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, zero), zero)

    neg = F.col("_n") - F.col("_pos")
    return out.select(
        *groups, "n_samples", "tn", "fp", "fn", "tp", "log_loss", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        ratio(tn, tn + fp).alias("specificity"), ratio(tn, tn + fn).alias("npv"),
        ((F.col("_rank_sum") - F.col("_pos") * (F.col("_pos") + 1) / 2.0) / F.nullif((F.col("_pos") * neg).cast("double"), zero)).alias("roc_auc"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def curve_points(df: DataFrame, groups: Sequence[str] = ("model",), y: str = "y", p: str = "p") -> DataFrame:
    """ROC and precision-recall points at every distinct score, from cumulative counts."""
    ranks = value_ranks(df, groups, p, {"pos": F.col(y).cast("long")})
    tp = (F.col("n_pos") - F.col("below_pos")).cast("double")
    at = (F.col("n") - F.col("below")).cast("double")
    return ranks.select(
        *groups, F.col(p).alias("threshold"), (tp / F.col("n_pos")).alias("tpr"),
        ((at - tp) / (F.col("n") - F.col("n_pos"))).alias("fpr"), (tp / at).alias("precision"))


def average_precision(df: DataFrame, groups: Sequence[str] = ("model",), y: str = "y", p: str = "p") -> DataFrame:
    """Sum over thresholds of recall gained times precision there."""
    ranks = value_ranks(df, groups, p, {"pos": F.col(y).cast("long")})
    gained = F.col("pos") / F.col("n_pos").cast("double")
    precision = (F.col("n_pos") - F.col("below_pos")) / (F.col("n") - F.col("below")).cast("double")
    return ranks.groupBy(*groups).agg(F.sum(gained * precision).alias("average_precision"))


def blend_losses(df: DataFrame, steps: int = 100) -> DataFrame:
    """Mean log-loss for every blend weight; the whole grid is one aggregate, rows are not multiplied."""
    grid = [i / steps for i in range(steps + 1)]
    wide = df.agg(*[F.avg(log_loss(F.col("y"), F.col("p1") * a + F.col("p2") * (1.0 - a))).alias(f"a{i}") for i, a in enumerate(grid)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("loss")) for i, a in enumerate(grid)]))
                       .alias("s")).select("s.*")


def best_blend(df: DataFrame, steps: int = 100) -> DataFrame:
    """Weight of the lowest loss; the smaller weight wins a tie."""
    return blend_losses(df, steps).agg(F.min_by("alpha", F.struct("loss", "alpha")).alias("alpha"), F.min("loss").alias("loss"))


def soft_vote(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("vote", total([F.col(c) for c in columns]) / float(len(columns))).withColumn(
        "vote_class", (F.col("vote") >= 0.5).cast("int"))


def cv_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return folds.groupBy("model").agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def leaderboard(metrics: DataFrame, by: str) -> DataFrame:
    """Rank of each model within a split; one row per model, so the window is small."""
    order = Window.partitionBy("split").orderBy(F.desc(by), "model")
    return metrics.select("split", "model", by, F.row_number().over(order).alias("rank"))


def overfit_gap(metrics: DataFrame) -> DataFrame:
    wide = metrics.groupBy("model").agg(F.max(F.when(F.col("split") == "train", F.col("f1"))).alias("train_f1"),
                                        F.max(F.when(F.col("split") == "test", F.col("f1"))).alias("test_f1"))
    gap = F.col("train_f1") - F.col("test_f1")
    return wide.withColumn("gap", gap).withColumn("status", F.when(gap > 0.15, "OVERFITTING").when(gap > 0.05, "mild overfit")
                                                  .when(gap < -0.05, "underfit?").otherwise("OK"))


def blended_importance(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """Each importance over its maximum, blended; inputs have one row per feature."""
    top_a = a.agg(F.max("importance").alias("m")).scalar()
    top_b = b.agg(F.max("importance").alias("m")).scalar()
    both = a.select("feature", (F.col("importance") / (top_a + 1e-10)).alias("first")).join(
        b.select("feature", (F.col("importance") / (top_b + 1e-10)).alias("second")), "feature")
    return both.withColumn("blended", F.col("first") * alpha + F.col("second") * (1.0 - alpha))


# fixed values: feature families by name fragment, first match wins
FAMILIES = [
    ("Numerical ESG", ["controversy", "esg_risk", "pillar", "env_", "social_", "gov_"]),
    ("NLP Linguistic", ["greenwashing", "vague", "hedge", "linguistic", "sentiment", "word"]),
    ("Categorical", ["sector", "industry", "bin", "tier", "flag", "segment"]),
    ("Scaled", ["scaled"]),
]


def feature_category(name: Column) -> Column:
    out = None
    for label, parts in FAMILIES:
        test = name.rlike("|".join(parts))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("Other")


def summarize_runs(runs: DataFrame, key: str = "id", value: str = "p") -> DataFrame:
    """Mean, population deviation and 95 % interval over repeated predictions (a fixed number of runs per id)."""
    return runs.groupBy(key).agg(F.avg(value).alias("mc_mean"), F.stddev_pop(value).alias("mc_std"),
                                 F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))


def summarize_array(df: DataFrame, values: str) -> DataFrame:
    """Mean, population deviation and 95 % interval of a row's own array of predictions, without a shuffle.

    The array must not be empty and holds no nulls; the interval interpolates between neighbours.
    """
    p = F.col(values)
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumns({"mc_mean": mean, "_sorted": F.sort_array(p)})
    square = F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("mc_mean")) * (x - F.col("mc_mean")))

    def quantile(q: float) -> Column:
        at = (n - 1) * F.lit(q)
        low, high = F.get("_sorted", F.floor(at).cast("int")), F.get("_sorted", F.ceil(at).cast("int"))
        return low + (at - F.floor(at)) * (high - low)

    return out.withColumns({"mc_std": F.sqrt(square / n), "ci_low": quantile(0.025), "ci_high": quantile(0.975)}).drop("_sorted")
