"""Linear and tree attributions, their summaries, and what-if operators over any fitted Spark ML model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloscope.functions.exprs import with_globals
from discloscope.functions.ranking import column_quantiles
from discloscope.session import staging_dir


def linear_attribution(df: DataFrame, coefficients: dict[str, float], key: str = "company_id") -> DataFrame:
    """Long form: coefficient * (value - mean) per entity and feature."""
    cols = list(coefficients)
    out = with_globals(df, df.agg(*[F.avg(c).alias(c) for c in cols]), "_m")
    return out.select(key, F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
        (F.lit(float(w)) * (F.col(c) - F.col(f"_m.{c}"))).alias("attribution")) for c, w in coefficients.items()])).alias("s")) \
        .select(key, "s.*")


def mean_abs_importance(attr: DataFrame) -> DataFrame:
    return attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))


#: places to which a contribution counts: what a value equal to the mean leaves is noise of the summation order
PLACES = 9


def attribution_summary(attr: DataFrame, key: str = "company_id") -> DataFrame:
    v = F.round("attribution", PLACES)
    return attr.groupBy(key).agg(
        F.sum(v).alias("net"), F.sum(F.when(v > 0, v).otherwise(0.0)).alias("positive_sum"),
        F.sum(F.when(v < 0, v).otherwise(0.0)).alias("negative_sum"), F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"))


def top_contributors(attr: DataFrame, entities: int = 10, features: int = 10, key: str = "company_id") -> DataFrame:
    """Entities with the largest total; for each, its largest contributions with direction and strength band."""
    leaders = attr.groupBy(key).agg(F.sum("attribution").alias("total")).orderBy(F.desc("total"), key).limit(entities)
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("attribution")), "feature")
    a = F.abs("attribution")
    return (attr.join(F.broadcast(leaders), key)  # at most ``entities`` rows
            .withColumn("feature_rank", F.row_number().over(order)).filter(F.col("feature_rank") <= features)
            .select(key, "total", "feature_rank", "feature", "attribution",
                    F.when(F.round("attribution", PLACES) > 0, "INCREASES").otherwise("DECREASES").alias("direction"),
                    F.when(a > 0.1, "strong").when(a > 0.05, "medium").otherwise("weak").alias("strength")))


# ------------------------------------------------------------------ trees
def tree_nodes(model, spark) -> pd.DataFrame:
    """Node table of a fitted tree or ensemble, read from the files Spark ML itself writes.

    ``value`` is what a row that ends in the node adds to the model's output: the weighted prediction of a regression
    tree (boosting), or the share of class 1 over the number of trees (classification trees). ``cover`` counts the
    training rows that came through.
    """
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    # bounded by the model
    nodes = data.select("treeID", "id", "prediction", "impurityStats", F.col("rawCount").alias("cover"), "leftChild", "rightChild",
                        F.col("split.featureIndex").alias("feature"), F.col("split.numCategories").alias("categories"),
                        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).toPandas()
    if (nodes["categories"] > 0).any():
        raise ValueError("categorical splits are not attributed")
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / nodes["treeID"].nunique()] * (1 + int(nodes["treeID"].max()))
    classes = not boosted and hasattr(model, "numClasses")
    if classes and model.numClasses != 2:
        raise ValueError("attributions are for two classes")
    own = [s[1] / sum(s) for s in nodes["impurityStats"]] if classes else nodes["prediction"]
    nodes["value"] = [v * weights[t] for v, t in zip(own, nodes["treeID"])]
    return nodes.sort_values(["treeID", "id"])


@dataclass(frozen=True)
class Leaf:
    """Where a row ends if every feature on the path lies in its range, and the share of rows that each one lets through."""

    value: float
    features: tuple[int, ...]
    above: tuple[float, ...]
    upto: tuple[float, ...]
    share: tuple[float, ...]


def leaves(nodes: pd.DataFrame) -> list[Leaf]:
    """Leaves of one tree; splits on one feature along a path merge into one range and one share."""
    feature, threshold, left, right, cover, value = (nodes[c].tolist() for c in ("feature", "threshold", "leftChild", "rightChild", "cover", "value"))
    out, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        if left[at] < 0:
            out.append(Leaf(value[at], tuple(path), *(tuple(p[k] for p in path.values()) for k in range(3))))
            continue
        f, cut = feature[at], threshold[at]
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        stack.append((left[at], {**path, f: (lo, min(hi, cut), share * cover[left[at]] / cover[at])}))
        stack.append((right[at], {**path, f: (max(lo, cut), hi, share * cover[right[at]] / cover[at])}))
    return out


def leaf_shapley(leaf: Leaf, x: np.ndarray, out: np.ndarray) -> None:
    """Adds the exact Shapley values of one leaf for all rows of ``x``.

    A set of known features gives the leaf the product of 1 or 0 (does the row lie in the range) over the known ones and
    of their shares over the others. With t counting the known ones, the product of (share + t * inside) over all
    features has the sums over all sets of a size as coefficients; dividing a feature's factor out leaves the sets
    without it, which are weighted by s! (m - s - 1)! / m!. That takes m^2 steps instead of 2^m sets.
    """
    m = len(leaf.features)
    if not m:
        return
    columns = [x[:, f] for f in leaf.features]
    inside = [((c <= hi) | (hi == np.inf)) & ~(c <= lo) for c, lo, hi in zip(columns, leaf.above, leaf.upto)]
    whole = np.zeros((m + 1, len(x)))
    whole[0] = 1.0
    for k, (share, on) in enumerate(zip(leaf.share, inside)):
        whole[1:k + 2] = whole[1:k + 2] * share + whole[:k + 1] * on
        whole[0] *= share
    size = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    for f, share, on in zip(leaf.features, leaf.share, inside):
        # inside: division by (share + t), from the highest power down; outside: division by the share
        rest, total = np.zeros(len(x)), np.zeros(len(x))
        for s in range(m - 1, -1, -1):
            rest = np.where(on, whole[s + 1] - share * rest, whole[s] / share)
            total += size[s] * rest
        out[:, f] += leaf.value * (on - share) * total


def tree_attribution(df: DataFrame, model, features: Sequence[str], key: str = "company_id") -> DataFrame:
    """Exact Shapley values of every feature for every row: ``key``, ``feature``, ``value``, ``attribution``, ``base``.

    The value of a set of features is the tree's expected output when those are known and the others split as the
    training rows did. ``base``, the value of the empty set, plus the attributions of a row is the model's output: the
    margin of boosted trees, the probability of class 1 of a forest or a decision tree. One pass over the rows; the
    leaf table is bounded by the model. Missing values go to the right of every split, as in the model.
    """
    trees = [leaves(t) for _, t in tree_nodes(model, df.sparkSession).groupby("treeID")]
    base = float(sum(leaf.value * np.prod(leaf.share) for tree in trees for leaf in tree))
    names = list(features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            out = np.zeros_like(x)
            for tree in trees:
                for leaf in tree:
                    leaf_shapley(leaf, x, out)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": np.tile(names, len(x)),
                                "value": x.ravel(), "attribution": out.ravel(), "base": base})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(
        explain, f"{key} long, feature string, value double, attribution double, base double")


# ------------------------------------------------------------------ what-if
def _probability(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return scored.withColumn("prob", F.get(vector_to_array("probability"), F.lit(1)))


def _with_value(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace the feature named in ``target`` by ``test_value``."""
    return df.withColumns({c: F.when(F.col("target") == c, F.col("test_value")).otherwise(F.col(c)) for c in features})


def _linear(model) -> bool:
    """Whether the margin of a fitted pipeline is a linear function of each feature, with the usual limit at 0."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import StandardScalerModel, VectorAssembler
    *first, last = getattr(model, "stages", [model])
    return (isinstance(last, LogisticRegressionModel) and last.numClasses == 2 and last.getThreshold() == 0.5
            and all(isinstance(s, (VectorAssembler, StandardScalerModel)) for s in first))


def _margin(column: str = "rawPrediction") -> Column:
    from pyspark.ml.functions import vector_to_array
    return F.get(vector_to_array(column), F.lit(1))


def counterfactuals(df: DataFrame, model, features: Sequence[str], candidates: Sequence[str], steps: int = 30,
                    key: str = "company_id") -> DataFrame:
    """First of ``steps`` even moves toward the column minimum (flagged) or maximum (not flagged) that flips the class.

    Steps are generated next to their row and reduced map-side, so only one row per
    entity and feature is shuffled. Where the margin is linear in each feature, its values at the row and at the goal say
    at which step it changes its sign; the model then tries this step and its neighbours instead of all steps.
    """
    linear = _linear(model)
    ends = df.agg(*[x for c in candidates for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.stddev_samp(c).alias(f"{c}_sd"))])
    now = model.transform(df).select(*df.columns, F.col("prediction").alias("current"), *([_margin().alias("_m0")] if linear else []))
    wide = with_globals(now, ends, "_e")
    goals = F.array(*[F.struct(
        F.lit(c).alias("target"), F.col(c).cast("double").alias("current_value"),
        F.when(F.col("current") == 1, F.col(f"_e.{c}_lo")).otherwise(F.col(f"_e.{c}_hi")).cast("double").alias("goal"),
        F.coalesce(F.nullif(F.col(f"_e.{c}_sd"), F.lit(0.0)), F.lit(1.0)).alias("sd")) for c in candidates])
    rows = wide.withColumn("g", F.explode(goals)).select(*df.columns, "current", "g.*", *(["_m0"] if linear else []))
    tries = F.sequence(F.lit(1), F.lit(steps - 1))
    if linear:
        kept = rows.columns
        rows = model.transform(_with_value(rows.withColumn("test_value", F.col("goal")), features)) \
            .select(*[F.col(c) for c in kept if c not in features], *[F.when(F.col("target") == c, F.col("current_value")).otherwise(F.col(c)).alias(c) for c in features],
                    _margin().alias("_m1"))
        share = -F.col("_m0") / F.nullif(F.col("_m1") - F.col("_m0"), F.lit(0.0))
        rows = rows.withColumn("_at", F.ceil(share * (steps - 1))).filter((F.col("_at") >= 0) & (F.col("_at") <= steps))
        tries = F.filter(tries, lambda s: (s >= F.col("_at") - 1) & (s <= F.col("_at") + 1))
    rows = rows.withColumn("step", F.explode(tries)).drop("_m0", "_m1", "_at")
    rows = rows.withColumn("test_value", F.col("current_value") + (F.col("goal") - F.col("current_value")) * F.col("step") / float(steps - 1))
    tried = _probability(model.transform(_with_value(rows, features)))
    flips = tried.filter(F.col("prediction") != F.col("current"))
    first = flips.groupBy(key, F.col("target").alias("feature")).agg(F.min_by(
        F.struct("current_value", F.col("test_value").alias("required_value"), F.col("prob").alias("new_probability"), "sd"), "step").alias("f"))
    change = F.col("f.required_value") - F.col("f.current_value")
    return first.select(key, "feature", "f.current_value", "f.required_value", change.alias("change"),
                        (change / (F.abs("f.current_value") + 1e-8) * 100.0).alias("change_pct"), "f.new_probability",
                        (change / F.col("f.sd")).alias("change_in_std"))


def what_if(df: DataFrame, model, features: Sequence[str], scenarios: dict[str, dict[str, float]], key: str = "company_id") -> DataFrame:
    """Override chosen features by scenario, re-score, and compare with the current score."""
    now = _probability(model.transform(df)).select(*df.columns, F.col("prob").alias("prob_before"), F.col("prediction").alias("before"))
    rows = now.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    moved = rows.withColumns({
        c: F.coalesce(*[F.when(F.col("scenario") == s, F.lit(float(o[c]))) for s, o in scenarios.items() if c in o], F.col(c).cast("double"))
        for c in features if any(c in o for o in scenarios.values())})
    out = _probability(model.transform(moved))
    return out.select(key, "scenario", "prob_before", F.col("prob").alias("prob_after"), (F.col("prob") - F.col("prob_before")).alias("delta"),
                      (F.col("prediction") != F.col("before")).alias("flipped"))


def sensitivity(df: DataFrame, model, features: Sequence[str], candidates: Sequence[str], points: int = 50,
                key: str = "company_id") -> DataFrame:
    """Per entity and feature: probability at the 2nd and 98th percentile, range over the sweep, and whether it can flip."""
    q = column_quantiles(df, candidates, {"lo": 0.02, "hi": 0.98})
    live = [c for c in candidates if q[f"{c}_lo"] < q[f"{c}_hi"]]
    goals = F.array(*[F.struct(F.lit(c).alias("target"), F.lit(q[f"{c}_lo"]).alias("lo"), F.lit(q[f"{c}_hi"]).alias("hi")) for c in live])
    rows = df.withColumn("g", F.explode(goals)).select(*df.columns, "g.*").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = rows.withColumn("test_value", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / float(points - 1))
    tried = _probability(model.transform(_with_value(rows, features)))
    out = tried.groupBy(key, F.col("target").alias("feature")).agg(
        F.min_by("prob", "step").alias("prob_low"), F.max_by("prob", "step").alias("prob_high"),
        (F.max("prob") - F.min("prob")).alias("prob_range"))
    low, high = F.col("prob_low"), F.col("prob_high")
    return out.withColumn("can_flip", ((low < 0.5) & (high > 0.5)) | ((high < 0.5) & (low > 0.5)))
