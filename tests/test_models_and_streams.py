"""Training, attribution, neighbours, anomaly scores, and batch = stream."""

import datetime as dt
import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from discloscope.operators import attribution as A
from discloscope.operators import evaluation as E
from discloscope.operators import training as T
from discloscope.session import staging_dir
from discloscope.sources import adapters as AD
from discloscope.streaming import live as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    return spark.createDataFrame(pd.DataFrame({"company_id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))


def expected(nodes, x, known, at=0):
    """A tree's output when only the ``known`` features of ``x`` are."""
    n = nodes.iloc[at]
    if n.leftChild < 0:
        return n.value
    if n.feature in known:
        return expected(nodes, x, known, int(n.leftChild if x[int(n.feature)] <= n.threshold else n.rightChild))
    return sum(nodes.iloc[int(c)].cover / n.cover * expected(nodes, x, known, int(c)) for c in (n.leftChild, n.rightChild))


def shapley(trees, x, i):
    """Brute force over all sets of the other features."""
    others = [f for f in range(len(x)) if f != i]
    total = 0.0
    for size in range(len(x)):
        weight = math.factorial(size) * math.factorial(len(x) - size - 1) / math.factorial(len(x))
        for known in itertools.combinations(others, size):
            total += weight * sum(expected(t, x, {*known, i}) - expected(t, x, set(known)) for t in trees)
    return total


@pytest.mark.parametrize("family", ["gradient_boosting", "random_forest", "decision_tree"])
def test_tree_attribution_is_exact(spark, rows, family):
    names = ["a", "b", "c"]
    estimator = T.estimators()[family].copy({T.estimators()[family].maxDepth: 3})
    if family != "decision_tree":
        estimator = estimator.copy({estimator.maxIter if family == "gradient_boosting" else estimator.numTrees: 4})
    model = T.pipeline(estimator, names, standardize=False).fit(rows)
    some = rows.filter("company_id < 40").withColumn("a", F.when(F.col("company_id") == 7, float("nan")).otherwise(F.col("a")))
    attr = A.tree_attribution(some, model.stages[-1], names).toPandas()
    sums = attr.groupby("company_id")["attribution"].sum() + attr.groupby("company_id")["base"].first()
    from pyspark.ml.functions import vector_to_array
    output = "rawPrediction" if family == "gradient_boosting" else "probability"
    raw = model.transform(some).select("company_id", F.get(vector_to_array(output), F.lit(1)).alias("r")).toPandas().set_index("company_id")["r"]
    assert np.allclose(sums.sort_index(), raw.sort_index())
    trees = [t for _, t in A.tree_nodes(model.stages[-1], spark).groupby("treeID")]
    data = some.toPandas().set_index("company_id")[names]
    got = attr.set_index(["company_id", "feature"])["attribution"]
    for company in (0, 7, 11, 39):
        for i, name in enumerate(names):
            assert got[company, name] == pytest.approx(shapley(trees, data.loc[company].tolist(), i), abs=1e-9)


def test_folds_have_equal_shares(spark):
    df = spark.createDataFrame([(i, float(i % 7 == 0)) for i in range(331)] + [(2**31 + 5, 0.0), (5 + 2**32, 0.0)], "company_id long, label double")
    got = E.stratified_folds(df, "company_id", "label", 4).groupBy("label", "fold").count().toPandas()
    assert got.groupby("label")["count"].agg(lambda c: c.max() - c.min()).max() <= 1 and got["count"].sum() == 333


def test_search_covers_families_and_refits_the_best(spark, rows):
    names = ["a", "b", "c"]
    data = E.stratified_folds(rows, "company_id", "label", 3).cache()
    grids = {"decision_tree": {"maxDepth": [1, 4]}, "logistic_regression": {"regParam": [0.01], "elasticNetParam": [0.0, 1.0]}}
    found = T.grid_search(data, names, grids, folds=3)
    assert [p[:2] for p in found.points] == [("decision_tree", "maxDepth=1"), ("decision_tree", "maxDepth=4"),
                                             ("logistic_regression", "regParam=0.01, elasticNetParam=0.0"), ("logistic_regression", "regParam=0.01, elasticNetParam=1.0")]
    family, point, score, _ = found.points[found.best]
    assert family == "logistic_regression" and score == max(p[2] for p in found.points) > 0.9
    # the mean over the folds by hand, and the refit against a direct fit
    base = T.estimators()[family]
    direct = base.copy({base.elasticNetParam: float(point[-3:])})
    by_hand = []
    for fold in range(3):
        told = T.pipeline(direct, names).fit(data.filter(f"fold <> {fold}")).transform(data.filter(f"fold = {fold}")).toPandas()
        tp = ((told.prediction == 1) & (told.label == 1)).sum()
        by_hand.append(2 * tp / ((told.prediction == 1).sum() + (told.label == 1).sum()))
    assert score == pytest.approx(np.mean(by_hand))
    assert np.allclose(found.model.stages[-1].coefficients, T.pipeline(direct, names).fit(data).stages[-1].coefficients)


def test_boosting_stops_where_the_loss_does(spark, rows):
    names = ["a", "b", "c"]
    noisy = rows.withColumn("label", F.when(F.col("company_id") % 6 == 0, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("held", F.col("company_id") % 4 == 0)
    est = T.estimators()["gradient_boosting"]
    est = est.copy({est.subsamplingRate: 1.0, est.maxIter: 15, est.stepSize: 0.4})
    model = T.monitored_boosting(noisy, names, est, "held", tolerance=0.01)
    whole = T.pipeline(est, names).fit(noisy.filter("not held"))
    # the scaler sees all rows in one case; trees do not care
    losses = T.staged_losses(whole, noisy.filter("held"))
    best, kept = losses[0], 1
    for i, loss in enumerate(losses[1:], 2):
        if best - loss < 0.01 * max(loss, 0.01):
            break
        best, kept = loss, i
    assert model.stages[-1].getNumTrees == kept < 15
    assert np.allclose(T.staged_losses(model, noisy.filter("held")), losses[:kept])


def test_resamples_do_not_depend_on_layout(spark, rows):
    names = ["a", "b", "c"]
    est = T.estimators()["logistic_regression"]
    draws = rows.select(*[T.poisson_weight(F.col("company_id"), r, 0.8).alias(f"d{r}") for r in range(30)]).toPandas().to_numpy()
    assert abs(draws.mean() - 0.8) < 0.03 and abs(draws.var() - 0.8) < 0.05
    one = T.bootstrap_predictions(rows.repartition(7), rows, names, est, runs=4)
    two = T.bootstrap_predictions(rows.orderBy(F.desc("a")), rows.repartition(3), names, est, runs=4)
    one, two = (E.summarize_array(x, "ps").toPandas().set_index("company_id").sort_index() for x in (one, two))
    for c in ("mc_mean", "mc_std", "ci_low", "ci_high"):
        assert np.allclose(one[c], two[c], atol=1e-6)
    ps = np.array(one["ps"].tolist())
    assert np.allclose(one["mc_mean"], ps.mean(1)) and np.allclose(one["mc_std"], ps.std(1)) and np.allclose(one["ci_high"], np.quantile(ps, 0.975, axis=1))
    # the same weights by hand
    held = rows.withColumn("w", T.poisson_weight(F.col("company_id"), 2, 0.8))
    prep = T.pipeline(est, names).getStages()[:-1]
    stage = T.Pipeline(stages=prep).fit(held)
    direct = est.copy({est.weightCol: "w"}).fit(stage.transform(held))
    from pyspark.ml.functions import vector_to_array
    p = direct.transform(stage.transform(held)).select("company_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).toPandas().set_index("company_id")["p"].sort_index()
    assert np.allclose(ps[:, 2], p, atol=1e-6)


def test_what_if_operators(rows):
    names = ["a", "b", "c"]
    model = T.pipeline(T.estimators()["logistic_regression"], names).fit(rows)
    df = rows.drop("label")
    cf = A.counterfactuals(df, model, names, ["a"]).toPandas()
    assert len(cf) > 100 and (cf["change"] != 0).all()
    flips = A.what_if(df, model, names, {"low": {"a": -9.0}}).filter("flipped").count()
    assert flips > 50
    sens = A.sensitivity(df, model, names, ["a", "c"]).groupBy("feature").agg(F.avg("prob_range").alias("r")).toPandas().set_index("feature")["r"]
    assert sens["a"] > sens["c"]


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 2))
    x[:20] += 12
    df = spark.createDataFrame(pd.DataFrame({"company_id": range(1000), "a": x[:, 0], "b": x[:, 1]}))
    out = T.isolation_forest(df, ["a", "b"], trees=60, contamination=0.02).toPandas()
    assert out["is_anomaly"].sum() == 20
    assert out.loc[out["company_id"] < 20, "is_anomaly"].mean() > 0.9


@pytest.mark.parametrize("rows, tile", [(512, 20_000), (37, 20_000), (512, 100), (64, 5)])
def test_neighbours_match_brute_force(spark, rows, tile):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[:200] = x[0] + rng.normal(scale=0.01, size=(200, 8))  # a third of the rows in one spot
    lab = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, lab))], "id long, vec array<double>, label int")
    got = T.nearest_neighbours(df.filter("id % 4 <> 0"), df.filter("id % 4 = 0"), k=5, rows=rows, tile=tile)
    got = got.groupBy("qid").agg(F.sort_array(F.collect_list("tid")).alias("t")).toPandas().set_index("qid")["t"]
    train = np.array([i for i in range(600) if i % 4])
    for q in range(0, 600, 4):
        d = ((x[train] - x[q]) ** 2).sum(1)
        assert list(got[q]) == sorted(train[np.argsort(d, kind="stable")[:5]])


def test_votes_agree_with_the_sql_beyond_one_tile(spark):
    """25,000 rows: the query and its SQL see the same neighbours."""
    import duckdb

    from discloscope.plans.catalog import QUERIES
    folder = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    rng = np.random.default_rng(9)
    # few distinct values, so that ties abound
    x = np.concatenate([rng.integers(0, 3, (25_000, 3)) / 2, np.zeros((25_000, 61))], axis=1)
    pdf = pd.DataFrame({"vec_id": range(25_000), "embedding": list(x.astype("float32")), "label": rng.integers(0, 4, 25_000).astype("int32")})
    pdf = pdf[(pdf["vec_id"] % 5 != 4) | (pdf["vec_id"] % 500 == 4)]
    spark.createDataFrame(pdf, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    got = {r.id: r.predicted for r in QUERIES["knn_vote"].run(spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert got == dict(con.execute(QUERIES["knn_vote"].sql).fetchall()) and len(got) == 50


def test_neighbours_of_a_bounded_sample(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(50)], "id long, vec array<double>, label int")
    got = T.nearest_neighbours(df, df, k=3, max_labelled=10).toPandas()
    assert got["tid"].nunique() == 10 and (got.groupby("qid").size() == 3).all()
    assert T.nearest_neighbours(df.limit(0), df).count() == 0


@pytest.mark.parametrize("n", [1, 300, 384_000_000, 10**10, 10**13])
def test_sampling_share_at_any_size(n):
    share = (T.sampling_edge(n, 256) + 1 + (1 << 63)) / (1 << 64)
    assert share == pytest.approx(min(1.0, 1.5 * 256 / n), rel=1e-6)


def test_feature_guard(rows):
    df = rows.withColumns({"gw_proxy_score": F.lit(1), "controversy_risk_ratio": F.lit(0.1), "controversy_risk_ratio_scaled": F.lit(0.1)})
    assert T.select_features(df.drop("label")) == ["a", "b", "c"]
    assert "controversy_risk_ratio" in T.select_features(df, drop_label_inputs=False)


# ------------------------------------------------------------------ streams
@pytest.fixture(scope="module")
def landing(spark, sf):
    """Events as one file per day, one percent of them landing three days late."""
    e = AD.table(spark, sf, "events")
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    day = F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 100 == 7, 3).otherwise(0))
    e.withColumn("day", day).repartition(1).sortWithinPartitions("day").write.partitionBy("day").parquet(path)
    return path, e.schema


def stream_of(spark, landing):
    path, schema = landing
    return AD.articles(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path))


def test_windowed_stream_equals_batch(spark, sf, landing):
    scored = L.score_articles(stream_of(spark, landing)).withWatermark("published", "10 days")
    name = "w" + uuid.uuid4().hex
    q = L.windowed_sentiment(scored).writeStream.outputMode("complete").format("memory").queryName(name).option(
        "checkpointLocation", f"{staging_dir(spark)}/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = L.windowed_sentiment(L.score_articles(AD.articles(AD.table(spark, sf, "events"))))
    a = spark.table(name).toPandas().sort_values(["company_id", "window_start"]).reset_index(drop=True)
    b = batch.toPandas().sort_values(["company_id", "window_start"]).reset_index(drop=True)
    assert len(a) == len(b) and np.allclose(a["mean_weighted"], b["mean_weighted"]) and (a["n_articles"] == b["n_articles"]).all()


def test_incremental_state_equals_one_batch(spark, sf, landing):
    state, mark = (f"{staging_dir(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    q = L.incremental_scoring(AD.deliveries(stream_of(spark, landing)), state, mark, delay="40 days")
    q.awaitTermination()
    got = L.latest_state(spark, state).toPandas().set_index("company_id").sort_index()
    whole = L.batch_totals(L.score_articles(AD.articles(AD.table(spark, sf, "events")))).toPandas().set_index("company_id").sort_index()
    assert (got["n"] == whole["n"]).all() and (got["as_of"] == whole["as_of"]).all()
    assert np.allclose(got["weighted_sum"], whole["weighted_sum"])


def test_killed_batch_is_replayed(spark, sf, landing, monkeypatch):
    """A run that dies after writing a batch, and one that dies before, end in the state of a run that does not."""
    state, mark = (f"{staging_dir(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    from pyspark.sql.streaming import DataStreamWriter
    plain, died = DataStreamWriter.foreachBatch, []

    def dying(self, write):
        def once(batch, batch_id):
            if batch_id == 2 and "before" not in died:
                died.append("before")
                raise RuntimeError("killed before the write")
            write(batch, batch_id)
            if batch_id == 4 and "after" not in died:
                died.append("after")
                raise RuntimeError("killed after the write")
        return plain(self, once)

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", dying)
    for _ in range(3):
        q = L.incremental_scoring(AD.deliveries(stream_of(spark, landing)), state, mark, delay="40 days")
        try:
            q.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)
    assert died == ["before", "after"]
    got = L.latest_state(spark, state).toPandas().set_index("company_id").sort_index()
    whole = L.batch_totals(L.score_articles(AD.articles(AD.table(spark, sf, "events")))).toPandas().set_index("company_id").sort_index()
    assert (got["n"] == whole["n"]).all() and np.allclose(got["weighted_sum"], whole["weighted_sum"])
    # a batch writes the companies it changes only
    rows = spark.read.schema(f"{L.CHANGES}, batch int").parquet(state)
    assert rows.filter("batch = 3").select("company_id").distinct().count() < len(whole)


def test_seen_articles_expire(spark):
    """What the watermark has passed is forgotten, and a repeat of it is late."""
    t = dt.datetime(2024, 1, 1)
    folder, state, mark = (f"{staging_dir(spark)}/{uuid.uuid4().hex}" for _ in range(3))
    schema = "company_id long, url string, title string, published timestamp"
    batches = [[(1, "a", "growth", t), (1, "a", "growth", t), (2, "z", "scandal", t)], [(1, "b", "growth", t + dt.timedelta(days=9))],
               [(1, "c", "growth", t + dt.timedelta(days=9, hours=1))], [(1, "a", "growth", t), (1, "b", "growth", t + dt.timedelta(days=9))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        L.incremental_scoring(stream, state, mark, delay="2 days").awaitTermination()
    assert {r.company_id: r.n for r in L.latest_state(spark, state).collect()} == {1: 3, 2: 1}
    held = spark.read.format("statestore").option("path", mark).option("stateVarName", "score").load().select("key.*", "value.*").collect()
    assert sorted(len(r["urls"]) for r in held if r["company_id"] == 2) == [0]


def test_decay_composes(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, f"growth {i}", t + dt.timedelta(hours=7 * i)) for i in range(40)]
    df = L.score_articles(spark.createDataFrame(rows, "company_id long, title string, published timestamp"))
    cut = F.lit(t + dt.timedelta(hours=100))
    merged = L.merge_totals(L.batch_totals(df.filter(F.col("published") < cut)), L.batch_totals(df.filter(F.col("published") >= cut))).first()
    assert merged["n"] == 40
    assert merged["weighted_sum"] == pytest.approx(L.batch_totals(df).first()["weighted_sum"])


def test_no_articles_keep_base_out_of_the_result(spark):
    empty = spark.createDataFrame([], "company_id long, title string, published timestamp")
    assert L.entity_delta(L.score_articles(empty), dt.datetime(2024, 1, 1)).count() == 0


def test_landed_batches_are_slices(spark, monkeypatch):
    """A slice of several files is one micro-batch, however the table is cut: rows after the newest of a slice would be late."""
    from discloscope.plans import model_plans as M
    monkeypatch.setattr(M, "FILE_ROWS", 10)
    folder = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    events = spark.range(0, 720, 1, 5).select(F.col("id").alias("event_id"), t.cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
                                              F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.write.parquet(f"{folder}/events.parquet")
    seen = []

    def note(batch, _):
        seen.append(batch.select(F.min("published"), F.max("published"), F.count_distinct("article_id")).first())

    M.landed(spark, folder).writeStream.foreachBatch(note).option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == M.SLICES and sum(s[2] for s in seen) == 720
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_only_busy_companies_are_kept_in_parts(spark):
    """A key and batch cost a call of its own, so a company with few articles is one key; sums do not depend on it."""
    t = dt.datetime(2024, 1, 1)
    rows = [(0 if i % 2 else i, f"u{i}", "growth", t + dt.timedelta(minutes=i)) for i in range(1, 1200)]
    folder, state, mark = (f"{staging_dir(spark)}/{uuid.uuid4().hex}" for _ in range(3))
    schema = "company_id long, url string, title string, published timestamp"
    articles = spark.createDataFrame(rows, schema)
    busy = L.busy_companies(articles)
    assert busy == [0]
    articles.write.parquet(folder)
    L.incremental_scoring(spark.readStream.schema(schema).parquet(folder), state, mark, "2 days", busy).awaitTermination()
    changes = spark.read.schema(f"{L.CHANGES}, batch int").parquet(state)
    assert changes.filter("company_id = 0").select("part").distinct().count() == L.PARTS
    assert changes.filter("company_id <> 0").count() == 599
    got, whole = (d.select("company_id", "n", "as_of", F.round("weighted_sum", 9)).orderBy("company_id").collect()
                  for d in (L.latest_state(spark, state), L.batch_totals(L.score_articles(articles))))
    assert got == whole


def test_linear_counterfactuals_try_the_crossing_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"company_id": [*range(299), 0], "a": rng.normal(size=300), "b": rng.integers(0, 6, 300), "c": np.round(rng.normal(size=300), 1), "k": 2.0})
    pdf["label"] = (pdf["a"] + 0.4 * pdf["b"] - 0.7 * pdf["c"] + rng.normal(size=300) > 1).astype(float)
    names = ["a", "b", "c", "k"]
    df = spark.createDataFrame(pdf)
    model = T.pipeline(T.estimators()["logistic_regression"], names).fit(df)
    tree = T.pipeline(T.estimators()["random_forest"], names).fit(df)
    assert A._linear(model) and not A._linear(tree)

    def found():
        out = A.counterfactuals(df.drop("label"), model, names, names).toPandas()
        return out.sort_values(["company_id", "feature"]).reset_index(drop=True)
    few = found()
    monkeypatch.setattr(A, "_linear", lambda m: False)  # every step is tried
    assert len(few) > 100
    pd.testing.assert_frame_equal(few, found(), check_exact=True)
