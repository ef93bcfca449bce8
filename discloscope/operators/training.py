"""Spark ML training: feature selection, classifiers, grid search, bootstrap, isolation forest, nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.functions.exprs import finite
from discloscope.functions.ranking import column_quantiles
from discloscope.operators.labels import MISMATCH_INDICATOR, QUANTILE_INDICATORS
from discloscope.session import materialize

NEVER_FEATURES = {"company_id", "gw_proxy_score", "gw_label_binary", "gw_label_multiclass", *[f"gw_indicator_{i}" for i in range(1, 6)]}


def select_features(df: DataFrame, drop_label_inputs: bool = True) -> list[str]:
    """Numeric columns that are no id, label or indicator; label inputs are left out unless asked for."""
    inputs = {*QUANTILE_INDICATORS.values(), MISMATCH_INDICATOR[1]} if drop_label_inputs else set()
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
            and f.name not in NEVER_FEATURES and not any(f.name == i or f.name == f"{i}_scaled" for i in inputs)]


def prepare(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features])


def pipeline(estimator, features: Sequence[str], standardize: bool = True) -> Pipeline:
    """The scaler is fitted with the estimator, so it only ever sees training rows."""
    raw = VectorAssembler(inputCols=list(features), outputCol="raw_vector", handleInvalid="keep")
    if not standardize:
        return Pipeline(stages=[raw.setOutputCol("features"), estimator])
    return Pipeline(stages=[raw, StandardScaler(inputCol="raw_vector", outputCol="features", withMean=True), estimator])


def estimators(label: str = "label", weight: str | None = None, seed: int = 42) -> dict[str, object]:
    """Configurations by model family; the two external boosters of the source map to two boosted-tree settings."""
    common = {"labelCol": label, "featuresCol": "features"}
    weighted = {**common, "weightCol": weight} if weight else common
    return {
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **weighted),
        "gradient_boosting": GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=seed, **common),
        "gradient_boosting_slow": GBTClassifier(maxIter=30, maxDepth=5, stepSize=0.05, subsamplingRate=0.85, seed=seed, **common),
        "logistic_regression": LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=0.0, **weighted),
        "linear_margin": LinearSVC(maxIter=50, regParam=0.01, **weighted),
        "decision_tree": DecisionTreeClassifier(maxDepth=6, seed=seed, **weighted),
    }


@dataclass(frozen=True)
class Search:
    """Points tried (family, parameters, mean and deviation of the score over the folds), the best one and its model."""

    points: list[tuple[str, str, float, float]]
    best: int
    model: object


#: values tried by family; a point is one of each
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]},
    "linear_margin": {"regParam": [0.01, 0.1]},
    "decision_tree": {"maxDepth": [4, 6]},
    "random_forest": {"maxDepth": [4, 8], "numTrees": [30]},
    "gradient_boosting": {"maxDepth": [3, 5], "maxIter": [10]},
}


def grid_search(train: DataFrame, features: Sequence[str], grids: dict[str, dict[str, list]] | None = None, label: str = "label",
                weight: str | None = None, folds: int = 5, parallelism: int = 4) -> Search:
    """Cross-validated F1 of class 1 for every point of every family, and the best point refitted on all rows.

    Folds come from column ``fold`` (0 to ``folds`` - 1). One search covers all families, so a fold's rows are cached
    once for all points; the scaler is part of a point and sees its training folds only. Ties go to the first point.
    """
    pipe, points, maps = Pipeline(stages=[]), [], []
    for family, values in (GRIDS if grids is None else grids).items():
        base = estimators(label, weight)[family]
        for chosen in product(*values.values()):
            point = dict(zip(values, chosen))
            stages = pipeline(base.copy({base.getParam(k): v for k, v in point.items()}), features).getStages()
            maps.append({pipe.stages: stages})
            points.append((family, ", ".join(f"{k}={v}" for k, v in point.items())))
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, numFolds=folds, foldCol="fold", evaluator=score, parallelism=parallelism).fit(train)
    return Search([(*p, float(m), float(d)) for p, m, d in zip(points, cv.avgMetrics, cv.stdMetrics)], int(np.argmax(cv.avgMetrics)), cv.bestModel)


def monitored_boosting(rows: DataFrame, features: Sequence[str], estimator: GBTClassifier, validation: str, tolerance: float = 0.01):
    """Boosted trees that stop when a round lowers the loss on the rows flagged in column ``validation`` by less than
    ``tolerance`` of it (of 0.01 at least), cut back to the best round. Flagged rows train no tree."""
    return pipeline(estimator.copy({estimator.validationIndicatorCol: validation, estimator.validationTol: tolerance}), features).fit(rows)


def staged_losses(model, rows: DataFrame) -> list[float]:
    """Loss of a fitted boosting pipeline over ``rows`` after each round; one pass for all rounds."""
    prepared = rows
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    return list(model.stages[-1].evaluateEachIteration(prepared))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    stage = model.stages[-1]
    values = stage.featureImportances if hasattr(stage, "featureImportances") else np.abs(stage.coefficients.toArray())
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, np.asarray(values.toArray() if hasattr(values, "toArray") else values))],
                                 "feature string, importance double")


def poisson_weight(key: Column, run: int, mean: float, seed: int = 42) -> Column:
    """How often a row is drawn in a resample: Poisson, from a hash of the row's key and the run alone."""
    uniform = F.shiftrightunsigned(F.xxhash64(key, F.lit(run), F.lit(seed)), 11) * F.lit(2.0 ** -53)
    edges, term, below = [], math.exp(-mean), math.exp(-mean)
    while below < 1.0 - 1e-12:
        edges.append(below)
        term *= mean / (len(edges))
        below += term
    return sum((F.when(uniform >= F.lit(e), 1.0).otherwise(0.0) for e in edges), F.lit(0.0))


def bootstrap_predictions(train: DataFrame, everyone: DataFrame, features: Sequence[str], estimator, runs: int = 20,
                          mean: float = 0.8, key: str = "company_id", parallelism: int = 4) -> DataFrame:
    """``key`` and ``ps``, the probabilities of class 1 by ``runs`` models refitted on resamples with replacement.

    A resample is a weight per row, drawn from the row's key, so it depends on neither partitions nor order. Vectors
    are made once and staged; every fit reads them and one weight. All models then score in one pass over ``everyone``.
    """
    from pyspark.ml.functions import vector_to_array
    prepare_ = Pipeline(stages=pipeline(estimator, features).getStages()[:-1]).fit(train)
    own = F.col(estimator.getWeightCol()) if estimator.isSet(estimator.weightCol) else F.lit(1.0)
    label = estimator.getLabelCol()
    drawn = {f"_draw_{r}": own * poisson_weight(F.col(key), r, mean) for r in range(runs)}
    staged = materialize(prepare_.transform(train).select("features", label, *[c.alias(n) for n, c in drawn.items()]))

    def fit(r: int):
        names = {estimator.weightCol: f"_draw_{r}", estimator.predictionCol: f"_class_{r}",
                 estimator.rawPredictionCol: f"_raw_{r}", estimator.probabilityCol: f"_p_{r}"}
        return estimator.copy(names).fit(staged.select("features", label, f"_draw_{r}"))

    with ThreadPool(min(parallelism, runs)) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(fit), range(runs))
    out = prepare_.transform(everyone).select(key, "features")
    for r, model in enumerate(models):
        out = model.transform(out).drop(f"_class_{r}", f"_raw_{r}")
    return out.select(key, F.array(*[F.get(vector_to_array(f"_p_{r}"), F.lit(1)) for r in range(runs)]).alias("ps"))


# ------------------------------------------------------------------ isolation forest
def _average_path(n):
    n = np.maximum(np.asarray(n, dtype=float), 1.0)
    return np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes as (feature, threshold, left, right, depth + path credit); left = -1 marks a leaf."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_cols = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_cols):
            nodes.append([0, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            return at
        f = int(rng.choice(open_cols))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append([f, cut, 0, 0, 0.0])
        side = x[rows, f] <= cut
        nodes[at][2], nodes[at][3] = add(rows[side], depth + 1), add(rows[~side], depth + 1)
        return at

    add(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def sampling_edge(n: int, sample: int) -> int:
    """Largest signed 64-bit hash that picks a row, so that about one and a half samples of ``n`` rows are picked."""
    share = min(1.0, 1.5 * sample / max(n, 1))
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63) - 1)


def isolation_forest(df: DataFrame, features: Sequence[str], trees: int = 300, sample: int = 256, contamination: float = 0.15,
                     seed: int = 42, key: str = "company_id") -> DataFrame:
    """Anomaly score per row and the flag of the top ``contamination`` share.

    Each row hashes itself into the few trees it trains, so a tree group holds about
    ``sample`` rows whatever the input size. Scoring is one pass with the node table
    (bounded by trees * sample) shipped to the tasks.
    """
    names = list(features)
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    n = rows.count()
    edge = sampling_edge(n, sample)
    # the full range of the hash: a share of one row in 10^10 is still more than 10^9 hash values
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col(key), t, F.lit(seed)) <= F.lit(edge))
    picked = rows.withColumn("tree", F.explode(chosen)).withColumn("_o", F.xxhash64(key, "tree", F.lit(seed + 1)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o").head(sample)
        tree = int(pdf["tree"].iloc[0])
        grown = _grow(pdf[names].to_numpy(dtype=float), np.random.default_rng(seed + tree), int(np.ceil(np.log2(max(len(pdf), 2)))))
        out = pd.DataFrame(grown, columns=["feature", "threshold", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        out["size"] = len(pdf)
        return out

    forest = picked.groupBy("tree").applyInPandas(
        build, "tree int, node int, feature int, threshold double, left int, right int, path double, size int").toPandas()
    packed = [t.sort_values("node")[["feature", "threshold", "left", "right", "path"]].to_numpy() for _, t in forest.groupby("tree")]
    norm = float(_average_path(forest.groupby("tree")["size"].first().mean()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            depth = np.zeros(len(x))
            for t in packed:
                at = np.zeros(len(x), dtype=int)
                live = t[at, 2] >= 0
                while live.any():
                    node = t[at[live]]
                    left = x[np.flatnonzero(live), node[:, 0].astype(int)] <= node[:, 1]
                    at[live] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                    live = t[at, 2] >= 0
                depth += t[at, 4]
            yield pd.DataFrame({key: pdf[key], "anomaly_score": 2.0 ** (-depth / len(packed) / norm)})

    scored = materialize(rows.mapInPandas(score, f"{key} long, anomaly_score double"))
    edge = column_quantiles(scored, ["anomaly_score"], {"edge": 1.0 - contamination})["anomaly_score_edge"]
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(edge)).cast("int"))


# ------------------------------------------------------------------ nearest neighbours
def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int = 5, max_labelled: int | None = None, tile: int = 20_000, rows: int = 512) -> DataFrame:
    """The k nearest training rows of every query; inputs have ``id`` and ``vec``, the training side ``label`` too.

    All training rows count or, with ``max_labelled``, those with so many smallest hashes of their ids. Up to ``tile``
    of them go to the tasks, which answer all queries in one map-side pass. More are hashed into tiles that every query
    meets, and each query keeps k rows a tile; these merge a bounded number of tiles at a time. A matrix product finds
    candidates, and their distances are taken again from the differences, so ties are exact and go to the smaller id.
    """
    # aliases keep the two sides apart where both come from one table
    held = train.select(F.col("id").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("label").alias("label"))
    if max_labelled is not None:
        held = held.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    asked = queries.select("id", F.col("vec").cast("array<double>").alias("vec"))
    n = held.count()
    if n <= tile:
        local = held.orderBy("id").toPandas()  # at most ``tile`` rows
        if local.empty:
            return train.sparkSession.createDataFrame([], "qid long, tid long, label int, d2 double")
        data = train.sparkSession.sparkContext.broadcast(local)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = _Labelled(data.value, k, rows)
            for pdf in batches:
                yield from near.of(pdf)

        return asked.mapInPandas(best, "qid long, tid long, label int, d2 double")

    tiles = -(-n // tile)
    left = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    right = held.withColumn("tile", F.pmod(F.xxhash64("id", "vec"), F.lit(tiles)))

    def meet(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parts = list(_Labelled(known.sort_values("id"), k, rows).of(pdf)) if len(pdf) and len(known) else []
        out = pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("qid", "int64"), ("tid", "int64"), ("label", "int32"), ("d2", "float64"))})
        return out.assign(tile=pdf["tile"].iloc[0] if len(pdf) else 0)

    found = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInPandas(meet, "qid long, tid long, label int, d2 double, tile long")
    listed, count = found.select("qid", "tile", F.struct("d2", "tid", "label").alias("hit")), tiles
    while True:
        count = -(-count // 64)
        listed = listed.groupBy("qid", F.floor(F.col("tile") / 64).alias("tile")).agg(F.slice(F.sort_array(F.collect_list("hit")), 1, k).alias("hits"))
        listed = listed.select("qid", "tile", F.explode("hits").alias("hit"))
        if count <= 1:
            return listed.select("qid", "hit.tid", "hit.label", "hit.d2")


class _Labelled:
    """Labelled rows in order of id, asked for the k nearest of each row of a batch."""

    def __init__(self, known: pd.DataFrame, k: int, rows: int):
        self.x = np.array(known["vec"].tolist(), dtype=float)
        self.norms, self.ids, self.labels = (self.x * self.x).sum(1), known["id"].to_numpy(), known["label"].to_numpy()
        self.k, self.rows = k, rows

    def of(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        near = min(len(self.x), self.k) - 1
        for at in range(0, len(pdf), self.rows):
            part = pdf.iloc[at:at + self.rows]
            q = np.array(part["vec"].tolist(), dtype=float)
            rough = self.norms[None] - 2.0 * (q @ self.x.T)
            # every row as near as the k-th, give or take rounding, is a candidate
            edge = np.partition(rough, near, axis=1)[:, near] + 1e-6 * (1.0 + np.abs(rough).max(axis=1))
            found = []
            for i in range(len(q)):
                c = np.flatnonzero(rough[i] <= edge[i])
                d2 = ((q[i] - self.x[c]) ** 2).sum(-1)
                order = np.argsort(d2, kind="stable")[:self.k]
                found.append((c[order], d2[order]))
            c = np.concatenate([f[0] for f in found])
            yield pd.DataFrame({"qid": np.repeat(part["id"].to_numpy(), [len(f[0]) for f in found]), "tid": self.ids[c], "label": self.labels[c],
                                "d2": np.concatenate([f[1] for f in found])})


def knn_vote(neighbours: DataFrame) -> DataFrame:
    """Majority label; the smaller label wins a tie."""
    votes = neighbours.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(F.col("qid").alias("id")).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("predicted"))
