"""Joins, panel aggregation, distributions, summaries and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions.ranking import _join_keys, attach_group, per_column, value_ranks

PANEL_MEASURES = ["revenue", "profit_margin", "market_cap", "growth_rate", "esg_overall", "esg_environmental", "esg_social",
                  "esg_governance", "carbon_emissions", "water_usage", "energy_consumption"]


def union_tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack aligned subsets; columns absent on one side become NULL."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn("source", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def normal_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def new_entities(candidates: DataFrame, known: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Candidates whose normalized key is not known; NULL keys stay."""
    keys = known.select(normal_key(F.col(right_key)).alias("_k")).distinct()
    return candidates.withColumn("_k", normal_key(F.col(left_key))).join(keys, "_k", "left_anti").drop("_k")


def shared_keys(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    return a.select(normal_key(F.col(a_key)).alias("key")).intersect(b.select(normal_key(F.col(b_key)).alias("key")))


def enrich(features: DataFrame, labels: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Bring in label columns only where they are absent."""
    wanted = [c for c in columns if c not in features.columns]
    return features.join(labels.select(key, *wanted), key, "left") if wanted else features


def panel_aggregate(panel: DataFrame, key: str = "company_id") -> DataFrame:
    measures = [c for c in PANEL_MEASURES if c in panel.columns]
    return panel.groupBy(key).agg(*[
        f(c).alias(f"{c}_{n}") for c in measures
        for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def latest_per_entity(panel: DataFrame, key: str, columns: Sequence[str], year: str = "year") -> DataFrame:
    """Last non-NULL value of each column by year."""
    return panel.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(year))).alias(f"{c}_latest") for c in columns])


def trend_volatility(panel: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    stats = panel.groupBy(key).agg(*[x for c in columns for x in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("year"))).alias(f"{c}_latest"))])
    return stats.select(key, *[x for c in columns for x in (
        F.coalesce(F.col(f"{c}_latest") - F.col(f"{c}_mean"), F.lit(0.0)).alias(f"{c}_trend"),
        F.coalesce(F.col(f"{c}_std") / F.nullif(F.col(f"{c}_mean"), F.lit(0.0)), F.lit(0.0)).alias(f"{c}_volatility"))])


def tier_distribution(df: DataFrame) -> DataFrame:
    """Every tier in fixed order, empty tiers included."""
    tiers = df.sparkSession.createDataFrame(list(enumerate(V.TIERS)), "tier_order int, risk_tier string")
    counts = df.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return tiers.join(counts, "risk_tier", "left").na.fill(0, ["n"]).withColumn("pct", F.col("n") / F.nullif(whole, F.lit(0)) * 100.0)


def value_distribution(df: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} int")
    counts = df.groupBy(F.col(column).cast("int").alias(column)).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return dim.join(counts, column, "left").na.fill(0, ["n"]).withColumn("pct", F.col("n") / F.nullif(whole, F.lit(0)) * 100.0)


def sector_summary(df: DataFrame, score: str = "risk_score") -> DataFrame:
    return df.groupBy("sector").agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score"),
                                    F.count(F.lit(1)).alias("n")).orderBy(F.desc("mean_score"), "sector")


def portfolio_summary(df: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    return df.groupBy("sector").agg(
        F.count(F.lit(1)).alias("companies"), F.bround(F.avg(s), 2).alias("mean_score"), F.bround(F.max(s), 2).alias("max_score"),
        F.count_if(s >= 60).alias("high_risk"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts; the maximum falls into the last bin. Empty bins are not listed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    row = ends.select(F.struct("lo", "hi").alias("e")).scalar()
    width = (row["hi"] - row["lo"]) / float(bins)
    bucket = F.when(width > 0, F.least(F.floor((F.col(column) - row["lo"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return (df.filter(F.col(column).isNotNull()).groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_start", row["lo"] + F.col("bin") * width))


def correlation_pairs(df: DataFrame, columns: Sequence[str], above: float | None = None) -> DataFrame:
    """Upper-triangle Pearson pairs, all from one aggregate; NULL for a constant column."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("s")).select("s.*")
    return long.filter(F.abs("r") > above) if above is not None else long


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    upper = correlation_pairs(df, columns)
    lower = upper.select(F.col("right").alias("left"), F.col("left").alias("right"), "r")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], upper.schema)
    return upper.unionByName(lower).unionByName(diagonal)


def feature_registry(df: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared features with dtype or 'removed', and statistics of those present (one wide aggregate)."""
    types = dict(df.dtypes)
    names = [r["feature"] for r in declared.select("feature").collect()]  # one row per declared feature
    live = [n for n in names if types.get(n, "string") != "string"]
    stats = per_column(df, live, lambda c: {
        "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(F.col(c).cast("double")), "max": F.max(F.col(c).cast("double")),
        "null_count": F.count_if(F.col(c).isNull())}).withColumnRenamed("column", "feature")
    dtype = df.sparkSession.createDataFrame([(n, types.get(n, "removed")) for n in names], "feature string, dtype string")
    return declared.join(dtype, "feature").join(stats, "feature", "left")


def peer_rank(df: DataFrame, group: str = "sector", score: str = "risk_score") -> DataFrame:
    """1 + number of peers with a higher score, peer count, group mean and distance to it."""
    ranks = value_ranks(df, [group], score)
    out = _join_keys(df, ranks, [group, score], "left")
    means = df.groupBy(group).agg(F.avg(score).alias("peer_mean"))
    out = attach_group(out, means, [group])
    return out.withColumns({"peer_rank": F.col("n") - F.col("below") - F.col("cnt") + 1, "peer_count": F.col("n"),
                            "delta": F.col(score) - F.col("peer_mean")}).drop("below", "cnt", "n")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), name, value)


def comparison(df: DataFrame, entities: DataFrame, metrics: Sequence[str], labels: Sequence[str], slots: Sequence[int]) -> DataFrame:
    """One row per metric: ``company_<slot>`` for the ``entities`` (``company_id``, ``slot``), numbers with the average of
    the sector of slot 1, and ``label_<slot>`` for metrics whose value is a text. A slot without an entity is NULL."""
    wide = attach_group(df, entities, ["company_id"])
    home = F.col("sector") == wide.filter(F.col("slot") == slots[0]).select(F.first("sector").alias("s")).scalar()

    def at(slot: int, value: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col(value)))

    numbers = melt(wide.withColumn("_home", home), ["slot", "_home"], metrics).groupBy("metric").agg(
        *[at(i, "value").alias(f"company_{i}") for i in slots], F.avg(F.when(F.col("_home"), F.col("value"))).alias("sector_avg"))
    named = wide.filter(F.col("slot").isNotNull()).select("slot", *[F.col(c).cast("string").alias(c) for c in labels])
    texts = named.unpivot(["slot"], list(labels), "metric", "label").groupBy("metric").agg(*[at(i, "label").alias(f"label_{i}") for i in slots])
    return numbers.unionByName(texts, allowMissingColumns=True)
