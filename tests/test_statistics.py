"""Distributed ranks, quantiles and positions against brute force, with heavy ties and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from discloscope.functions import ranking as R
from discloscope.functions.exprs import clip, cut
from discloscope.operators import cleaning as C
from discloscope.operators import evaluation as E
from discloscope.operators import numeric as M


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "id": range(n), "g": np.where(np.arange(n) % 3 == 0, "hot", ("k" + pd.Series(rng.integers(0, 9, n)).astype(str))),
        "v": np.where(np.arange(n) % 3 == 1, 5.0, np.round(rng.normal(5, 3, n), 2))})
    pdf.loc[::50, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_group_percentile(skewed):
    pdf, df = skewed
    got = R.with_value_ranks(df, ["g"], "v").select("id", R.average_percentile().alias("p"), (F.col("below") + 1).alias("r")).toPandas().set_index("id").sort_index()
    assert np.allclose(got["p"], pdf.groupby("g")["v"].rank(pct=True), equal_nan=True)
    assert np.allclose(got["r"].astype(float), pdf.groupby("g")["v"].rank(method="min"), equal_nan=True)


def test_small_percentile_fixture(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])], "id int, v double")
    got = R.with_value_ranks(df, [], "v").orderBy("id").select(R.average_percentile().alias("p")).collect()
    assert [r["p"] for r in got] == [0.25, 0.625, 0.625, 1.0]


def test_cut_points_do_not_change_ranks(skewed):
    _, df = skewed
    one = R.value_ranks(df, ["g"], "v", cuts=[]).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    many = R.value_ranks(df, ["g"], "v", cuts=[-1.0, 0.5, 5.0, 5.01, 9.0]).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many)


def test_ranks_of_few_values_meet_their_rows_without_a_shuffle(spark):
    """A shuffle by few values puts most rows into few tasks, which grow with the rows."""
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 2, float(i % 3)) for i in range(200)], "i int, g int, v double")
    ranked = R.with_value_ranks(df, ["g"], "v")
    assert "rightHint=(strategy=broadcast)" in ranked._jdf.queryExecution().optimizedPlan().toString()
    rows = df.collect()
    for r in ranked.collect():
        same = [x.v for x in rows if x.g == r.g]
        assert (r.cnt, r.below, r.n) == (same.count(r.v), sum(v < r.v for v in same), len(same))


def test_group_quantiles(skewed):
    pdf, df = skewed
    got = R.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.75}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.1, 0.75]).unstack()
    assert np.allclose(got[["a", "b"]], want)


@pytest.mark.parametrize("accuracy,gather", [(10_000, 2_000), (20, 10), (10, 1)])
def test_column_quantiles_narrowing(skewed, accuracy, gather):
    pdf, df = skewed
    probs = {"p02": 0.02, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p1": 1.0}
    got = R.column_quantiles(df, ["v", "id"], probs, accuracy, gather)
    for c in ("v", "id"):
        for name, p in probs.items():
            assert got[f"{c}_{name}"] == pytest.approx(pdf[c].quantile(p), abs=1e-9)


def test_quantile_between_two_hot_values(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 2.0).otherwise(F.col("id") / 1e6 + 1.2).alias("v"))
    want = np.quantile(df.toPandas()["v"], [0.2, 1 / 3, 0.5, 2 / 3, 0.9])
    got = R.column_quantiles(df, ["v"], {f"p{i}": p for i, p in enumerate([0.2, 1 / 3, 0.5, 2 / 3, 0.9])}, 100, 20)
    assert np.allclose(list(got.values()), want)


def test_empty_column_quantile(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert R.column_quantiles(df, ["v"], {"m": 0.5}) == {"v_m": None}


@pytest.mark.parametrize("rows", [None, 10, 10**9])
def test_figures_of_one_level(skewed, rows):
    pdf, df = skewed
    got = R.figures(df, {"v": {"q1": 0.25, "q3": 0.75}, "id": {"mid": 0.5}}, {"n": F.count(F.lit(1)), "top": F.max("id")}, rows, 50, 20)
    assert (got["n"], got["top"]) == (len(pdf), pdf["id"].max())
    for name, want in {"v_q1": pdf["v"].quantile(0.25), "v_q3": pdf["v"].quantile(0.75), "id_mid": pdf["id"].quantile(0.5)}.items():
        assert got[name] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("gather_all", [40_000, 30])
def test_figures_of_many_columns(spark, monkeypatch, gather_all):
    rng, n = np.random.default_rng(1), 3000
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 5, n) * 1.0, "c": np.where(rng.random(n) < 0.4, 3.25, rng.normal(size=n) * 1e-300),
        "d": rng.exponential(size=n) * 1e12, "e": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), "f": -rng.random(n), "g": 0.0,
        "h": np.nan, "i": np.where(rng.random(n) < 0.5, -0.0, 0.0), "j": 1 + rng.integers(0, 2000, n) * 2.0**-52, "k": np.arange(n) * 1.0})
    probs = {"z": 0.0, "q1": 0.25, "m": 0.5, "x": 0.999, "o": 1.0}
    # statistics of many columns take no sketches: thousands of aggregates would be one row's work
    monkeypatch.setattr(R.F, "percentile_approx", None)
    got = R.figures(spark.createDataFrame(pdf).repartition(3), {c: probs for c in pdf}, {"n": F.count(F.lit(1))}, gather_all=gather_all)
    assert got.pop("n") == n
    for c in pdf:
        for name, p in probs.items():
            want = pdf[c].quantile(p)
            assert got[f"{c}_{name}"] is None if np.isnan(want) else got[f"{c}_{name}"] == pytest.approx(want, rel=1e-12, abs=1e-320)


@pytest.mark.parametrize("rows", [None, 0])
def test_figures_of_nothing(spark, rows):
    empty = spark.createDataFrame([], "v double")
    assert R.figures(empty, {"v": {"m": 0.5}}, {"n": F.count(F.lit(1))}, rows) == {"v_m": None, "n": 0}


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (1.0,)], "v double")
    assert R.column_quantiles(df, ["v"], {"m": 0.5}) == R.column_quantiles(df, ["v"], {"m": 0.5}, rows=4) == {"v_m": 2.0}


def test_ordered_positions(skewed):
    pdf, df = skewed
    got = R.ordered_positions(df, [F.desc_nulls_last("v"), F.asc("id")], {"x": "id"}).toPandas().sort_values("position")
    want = pdf.sort_values(["v", "id"], ascending=[False, True], na_position="last")
    assert list(got["id"]) == list(want["id"])
    assert list(got["position"]) == list(range(1, len(pdf) + 1))
    assert list(got["x_running"]) == list(want["id"].cumsum())


def test_small_side_limit(spark):
    df = spark.range(50)
    assert R.small_side(df, 10) is df
    assert R.small_side(df, 100).count() == 50


def test_bins(spark):
    edge = 1e-9
    vals = [None, -1.0, 0.0, 0.25, 0.25 + edge, 0.5, 0.75, 1.0, 1.0 + edge]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["b"] for r in df.select("i", C.accusation_band(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == [None, None, "Low", "Low", "Moderate", "Moderate", "High", "Very High", None]
    left = [r["b"] for r in df.select("i", C.pillar_bin(F.col("v") * 12).alias("b")).orderBy("i").collect()]
    assert left == [2, 2, 0, 1, 1, 2, 2, 3, 3]
    assert df.select(clip(F.col("v"), 0, 1).alias("c")).filter("c is null").count() == 1
    assert df.select(cut(F.col("v"), [0, 1], ["in"]).alias("c")).filter("c is null").count() == 4


def test_number_parsing(spark):
    df = spark.createDataFrame([("3,157",), (" 12 ",), ("n/a",), (None,), ("50th percentile",), ("none",)], "s string")
    assert [r[0] for r in df.select(C.parse_thousands(F.col("s"))).collect()] == [3157.0, 12.0, None, None, None, None]
    assert [r[0] for r in df.select(C.first_number(F.col("s"))).collect()] == [3.0, 12.0, None, None, 50.0, None]


def test_keep_first_and_required(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("a", 2, "y"), ("b", 9, "q")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in C.keep_first(df, ["k"], "o").collect()} == {("a", "x"), ("b", "q")}
    with pytest.raises(ValueError, match="m1, m2"):
        C.require_columns(df, ["k", "m2", "m1"])


def test_skew_and_scaling(spark):
    rows = [(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 4.0), (3, 1.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "company_id int, env_risk_score double, social_risk_score double, gov_risk_score double")
    df = df.withColumns({"total_esg_risk_score": F.col("gov_risk_score"), "controversy_score": F.lit(1.0)})
    got = M.statistical_moments(df).orderBy("company_id").toPandas()["esg_pillar_skewness"]
    want = pd.DataFrame([r[1:] for r in rows]).skew(axis=1)
    assert np.allclose(got, want)
    with pytest.raises(ValueError, match="unknown scaling"):
        M.scale(df, ["controversy_score"], "nope")
    assert M.scale(df, ["controversy_score"], "minmax").agg(F.max("controversy_score_scaled")).first()[0] == 0.0
    assert abs(M.scale(df, ["total_esg_risk_score"], "power").agg(F.avg("total_esg_risk_score_scaled")).first()[0]) < 1e-9


def test_metrics_edges(spark):
    df = spark.createDataFrame([("m", "s", y, p) for y, p in ((0, 0.1), (1, 0.2), (0, 0.3))], "model string, split string, y int, p double")
    row = E.classification_metrics(df).first()
    assert row["precision"] == 0 and row["f1"] == 0 and row["roc_auc"] == 0.5
    tie = spark.createDataFrame([(1, 1.0, 1.0), (0, 0.0, 0.0)], "y int, p1 double, p2 double")
    assert E.best_blend(tie).first()["alpha"] == 0.0


def test_split_shares(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    n = {(r["y"], r["split"]): r["count"] for r in E.stratified_split(df, "id", "y", {"train": 0.8, "test": 0.2}).groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 532, (0, "test"): 134, (1, "train"): 267, (1, "test"): 67}


def test_profile_in_one_sweep(spark):
    """Against pandas: unknown values, large means, constants, copies, and any layout of the rows."""
    import pandas as pd

    from discloscope.operators.profile import column_profile
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n) + 1e7, "b": rng.normal(size=n), "seven": 7.0, "k": rng.integers(0, 5, n)})
    pdf["a2"], pdf["line"], pdf["gaps"], pdf["zero"] = pdf["a"], 3 * pdf["b"] + 1, np.where(rng.random(n) < 0.3, np.nan, pdf["b"] + 0.1 * rng.normal(size=n)), -0.0
    pdf["none"], pdf["plus"] = np.nan, 0.0
    names = [c for c in pdf.columns if c != "id"]
    df = spark.createDataFrame(pdf)
    one, two = column_profile(df.repartition(5), "id", names), column_profile(df.orderBy(F.desc("b")).coalesce(2), "id", names)
    assert (one.columns["print"] == two.columns["print"]).all() and one.constant() == two.constant() == ["seven", "zero", "none", "plus"]
    assert one.alike(["a", "b", "a2", "line", "gaps"]) == [("a", "a2")] and one.alike(["zero", "plus"]) == [("zero", "plus")]
    want = pdf[names].agg(["count", "mean", "std", "min", "max"]).T
    for c in ("a", "b", "k", "line", "gaps"):
        assert one.columns.loc[c, ["count", "mean", "std", "min", "max"]].astype(float).tolist() == pytest.approx(want.loc[c].tolist(), rel=1e-9)
    assert one.columns["null_count"].tolist() == pdf[names].isna().sum().tolist()
    some = ["a", "b", "k", "line", "gaps"]
    assert np.allclose(one.r.loc[some, some], pdf[some].corr(), atol=1e-9)
    assert ("b", "line") in [p[:2] for p in one.correlated(some, 0.98)]
    assert column_profile(df.limit(0), "id", names).constant() == names


def test_split_cuts_agree_with_ranks(spark):
    """Cuts and ranks give the same parts; ids that share a hash across a cut, missing ids and labels, and one-row labels included."""
    rows = [(i * 7919, i % 3 if i % 11 else None) for i in range(500)] + [(None, 0), (None, None), (5_000_001, 9)]
    shares = {"train": 0.6, "val": 0.2, "test": 0.2}
    for data in (rows, [(i % 5 * 2**31 + i // 5, 0) for i in range(50)], [(7, 1)] * 10):
        df = spark.createDataFrame(data, "id long, y int").withColumn("row", F.monotonically_increasing_id())
        got = E.stratified_split(df, "id", "y", shares).filter("id is not null")
        sizes = {(r["y"], r["split"]): r["count"] for r in got.groupBy("y", "split").count().collect()}
        for y in {y for i, y in data if i is not None}:
            n = sum(1 for i, v in data if v == y and i is not None)
            ends = [0, int(n * 0.6), int(n * (0.6 + 0.2)), n]
            assert [sizes.get((y, s), 0) for s in shares] == [b - a for a, b in zip(ends, ends[1:])]
        hashed = got.withColumn("h", E.split_hash(F.col("id"))).toPandas()
        for _, part in hashed.groupby("y", dropna=False):
            top = part.groupby("split")["h"].agg(["min", "max"]).reindex(list(shares)).dropna()
            assert all(a <= b for a, b in zip(top["max"], top["min"][1:]))
        assert set(E.stratified_split(df, "id", "y", shares).filter("id is null").toPandas()["split"]) <= {"test"}


def test_balanced_weights_with_a_missing_label(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0), (4, None)], "id long, y double")
    got = {r["id"]: r["weight"] for r in E.balanced_weights(df, "y").collect()}
    assert got == {1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(4 / 3), 4: None}


def test_forecast_band_is_that_of_the_residuals(spark):
    from discloscope.operators import timeseries as S
    rows = [("a", 2000 + i, v) for i, v in enumerate([3.0, 5.5, 4.0, 9.0])] + [("b", 2000 + i, 2.0 * i) for i in range(5)]
    rows += [("c", 2001, 1.0), ("c", 2002, 1.0), ("d", 2000, 1.0), ("d", 2001, None), ("d", 2002, 4.0), ("d", 2003, 4.0), ("e", 2000, None)]
    got = S.linear_forecast(spark.createDataFrame(rows, "k string, year int, v double"), ["k"], "v", 1, floor=None).toPandas().set_index("k")
    assert set(got.index) == {"a", "b", "d"}
    for k in got.index:
        x, y = np.array([(t, v) for g, t, v in rows if g == k and v is not None], dtype=float).T
        slope, start = np.polyfit(x - 2000, y, 1)
        spread = np.std(y - start - slope * (x - 2000))
        point = start + slope * (got.loc[k, "year"] - 2000)
        assert got.loc[k, ["forecast", "lower_bound", "upper_bound"]].astype(float).tolist() == pytest.approx(
            [point, point - 1.96 * spread, point + 1.96 * spread], abs=1e-6)
