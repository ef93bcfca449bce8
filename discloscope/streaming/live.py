"""Live article scoring: the same column logic serves batch and stream."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from discloscope.operators.sentiment import headline_sentiment
from discloscope.sources.readers import age_hours

DECAY_HOURS = 72.0


def recency_weight(hours: Column) -> Column:
    """e-folding decay: a weight of 1/e after 72 hours."""
    return F.exp(-hours / DECAY_HOURS)


def age_label(hours: Column) -> Column:
    return (F.when(hours < 1, F.concat(F.floor(hours * 60.0).cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24.0).cast("string"), F.lit("d ago"))))


def sentiment_class(s: Column) -> Column:
    return F.when(s < -0.1, "negative").when(s > 0.1, "positive").otherwise("neutral")


def score_articles(articles: DataFrame) -> DataFrame:
    return articles.withColumn("sentiment", headline_sentiment(F.col("title")))


def windowed_sentiment(scored: DataFrame, window: str = "1 day") -> DataFrame:
    """Decayed mean sentiment per company and window; the age is taken at the window end, so a replay agrees with a batch run."""
    w = F.window("published", window)
    rows = scored.withColumn("w", w)
    weighted = F.col("sentiment") * recency_weight(age_hours(F.col("published"), F.col("w.end")))
    return rows.withColumn("weighted", weighted).groupBy("w", "company_id").agg(
        F.avg("weighted").alias("mean_weighted"), F.count(F.lit(1)).alias("n_articles")) \
        .select("company_id", F.col("w.start").alias("window_start"), "mean_weighted", "n_articles")


def risk_delta(mean_weighted: Column) -> Column:
    return F.bround(mean_weighted * -15.0, 1)


def live_risk(windowed: DataFrame, base: DataFrame) -> DataFrame:
    """Join the static risk table; the new risk is the clamped base plus delta."""
    delta = risk_delta(F.col("mean_weighted"))
    return windowed.join(base, "company_id").withColumn("delta", delta).withColumn(
        "new_risk", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base_risk") + F.col("delta"))))


def alert_status(delta: Column) -> Column:
    return F.when(delta > 5, "ALERT").when(delta > 2, "WATCH").when(delta < -2, "IMPROVED").otherwise("STABLE")


def entity_delta(scored: DataFrame, reference: dt.datetime | Column) -> DataFrame:
    """Batch form over all articles up to a reference time."""
    ref = reference if isinstance(reference, Column) else F.lit(reference)
    weighted = F.col("sentiment") * recency_weight(age_hours(F.col("published"), ref))
    return scored.withColumn("weighted", weighted).groupBy("company_id").agg(
        F.avg("weighted").alias("mean_weighted"), F.count(F.lit(1)).alias("n_articles"))


def watched(articles: DataFrame, delay: str) -> DataFrame:
    """One article per company and URL.

    ``delay`` is the late-data rule: an article, or its repeat, counts if it comes within that event time of the newest
    one seen. With a delay that covers the disorder of the input, the result does not depend on micro-batches.
    """
    return articles.withWatermark("published", delay).dropDuplicatesWithinWatermark(["company_id", "url"])


# ------------------------------------------------------------------ incremental running mean
def _at(total: Column, as_of: Column, when: Column) -> Column:
    """Decay composes: a sum known at one time moves to a later one by a single factor."""
    return total * F.exp(-age_hours(as_of, when) / DECAY_HOURS)


def batch_totals(scored: DataFrame) -> DataFrame:
    """Per company, sum of decayed sentiment as of its newest article; partial sums combine before the shuffle."""
    epoch = F.lit(dt.datetime(2020, 1, 1))
    # hours since a fixed day keep the partial sums independent of the unknown newest time
    hours = age_hours(epoch, F.col("published"))
    by_hour = scored.withColumn("slot", F.floor(hours / 24.0)).groupBy("company_id", "slot").agg(
        F.sum(F.col("sentiment") * F.exp((hours - F.col("slot") * 24.0) / DECAY_HOURS)).alias("s"),
        F.count(F.lit(1)).alias("n"), F.max("published").alias("as_of"))
    newest = by_hour.groupBy("company_id").agg(
        F.max("as_of").alias("as_of"), F.sum("n").alias("n"), F.collect_list(F.struct("slot", "s")).alias("days"))  # one entry per day
    end = age_hours(epoch, F.col("as_of"))
    return newest.select("company_id", F.aggregate(
        "days", F.lit(0.0), lambda a, d: a + d["s"] * F.exp((d["slot"] * 24.0 - end) / DECAY_HOURS)).alias("weighted_sum"), "n", "as_of")


def merge_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("company_id", F.struct("weighted_sum", "n", "as_of").alias("o"))
    n = new.select("company_id", F.struct("weighted_sum", "n", "as_of").alias("w"))
    both = o.join(n, "company_id", "full_outer")
    as_of = F.greatest("o.as_of", "w.as_of")

    def part(side: str) -> Column:
        return F.coalesce(_at(F.col(f"{side}.weighted_sum"), F.col(f"{side}.as_of"), as_of), F.lit(0.0))

    return both.select("company_id", (part("o") + part("w")).alias("weighted_sum"),
                       (F.coalesce("o.n", F.lit(0)) + F.coalesce("w.n", F.lit(0))).alias("n"), as_of.alias("as_of"))


#: parts of a busy company whose state is kept apart, so that one with a third of all articles is no hot spot
PARTS = 8
#: a company with more than this share of all articles is busy; there can be no more of them than one over it
BUSY_SHARE = 1.0 / 256
CHANGES = "company_id long, part int, weighted_sum double, n long, as_of timestamp"
_CHANGED = CHANGES.replace("timestamp", "long")
_SCORE_STATE = "weighted_sum double, n long, as_of long, urls array<long>, seen array<long>"
_DECAY_MICROS = 3.6e9 * DECAY_HOURS


class DecayedScore(StatefulProcessor):
    """Keyed state of one part of a company: its decayed sum, and the articles that may still come again.

    An article counts once: its URL is remembered until the watermark has passed its time, when a repeat would be late
    and is not taken. A timer drops what is remembered of companies that no longer get articles; a key waits for one
    timer at a time. Rows are taken as they come: most keys get one or two a batch, for which a frame each is costly.
    """

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("score", _SCORE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get()
        total, n, as_of, urls, seen = (0.0, 0, None, [], []) if held is None else held
        known, new = dict(zip(urls, seen)), {}
        for r in rows:
            if r["at"] is not None and r["at"] >= late and r["url_hash"] not in known and r["url_hash"] not in new:
                new[r["url_hash"]] = r["at"], r["sentiment"]
        if not new:
            return
        newest = max(at for at, _ in new.values())
        newest = newest if as_of is None else max(newest, as_of)
        total = (0.0 if as_of is None else total * math.exp((as_of - newest) / _DECAY_MICROS)) + math.fsum(
            s * math.exp((at - newest) / _DECAY_MICROS) for at, s in new.values())
        n += len(new)
        if not known:  # else the timer of those still waits
            self._wait(max(at for at, _ in new.values()))
        known |= {u: at for u, (at, _) in new.items()}
        known = {u: t for u, t in known.items() if t >= late}
        self.state.update((total, n, newest, list(known), list(known.values())))
        yield Row(company_id=key[0], part=key[1], weighted_sum=total, n=n, as_of=newest)

    def _wait(self, newest: int) -> None:
        self.handle.registerTimer(newest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get()
        if held is not None:
            total, n, as_of, urls, seen = held
            known = {u: t for u, t in zip(urls, seen) if t >= late}
            self.state.update((total, n, as_of, list(known), list(known.values())))
            if known:
                self._wait(max(known.values()))
        return iter(())

    def close(self) -> None:
        pass


def busy_companies(articles: DataFrame) -> list[int]:
    """Companies of a known batch of articles, such as the history of a feed, that have more than ``BUSY_SHARE`` of them."""
    per = articles.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    whole = articles.count()
    return sorted(r["company_id"] for r in per.filter((F.col("n") > BUSY_SHARE * whole) & F.col("company_id").isNotNull()).collect())


def incremental_scoring(stream: DataFrame, state_dir: str, checkpoint: str, delay: str, busy: Sequence[int] | None = None):
    """Score only newly arrived articles and fold them into a per-company decayed sum.

    The sums are keyed state of the running query; what each micro-batch changes is written, and nothing else, to a
    folder of that batch, so a batch that is repeated after a failure replaces its own rows. ``delay`` is the late-data
    rule: an article, or its repeat, counts if it comes within that event time of the newest one seen.

    A call per key and batch is what costs, so only the companies in ``busy`` are kept in parts; without a list all are.
    The list has to stay the same for the life of a checkpoint, since a repeat is known to its own part only.
    """
    spark = stream.sparkSession
    # timers and state per key need the key-value state store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    part = F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")
    if busy is not None:
        part = F.when(F.col("company_id").isin(list(busy)), part).otherwise(0)
    rows = score_articles(stream.withWatermark("published", delay)).select(
        "company_id", part.alias("part"), F.xxhash64("company_id", "url").alias("url_hash"),
        F.unix_micros("published").alias("at"), "sentiment")
    changed = rows.groupBy("company_id", "part").transformWithState(DecayedScore(), _CHANGED, "Update", "EventTime")
    changed = changed.withColumn("as_of", F.timestamp_micros("as_of"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")

    return (changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """One row per company from the last change of each of its parts; parts combine, since decay composes."""
    rows = spark.read.schema(f"{CHANGES}, batch int").parquet(state_dir)
    last = rows.groupBy("company_id", "part").agg(F.max_by(F.struct("weighted_sum", "n", "as_of"), "batch").alias("s"))
    parts = last.groupBy("company_id").agg(F.max("s.as_of").alias("as_of"), F.sum("s.n").alias("n"), F.collect_list("s").alias("parts"))  # PARTS at most
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + _at(p["weighted_sum"], p["as_of"], F.col("as_of")))
    return parts.select("company_id", total.alias("weighted_sum"), "n", "as_of")


def latest_alerts(spark: SparkSession, state_dir: str) -> DataFrame:
    """The status of every company as of its newest article, from the changes written so far."""
    delta = risk_delta(F.col("weighted_sum") / F.col("n"))
    return latest_state(spark, state_dir).select("company_id", "n", "as_of", delta.alias("delta"), alert_status(delta).alias("status"))


def timeline_stream(stream: DataFrame, folder: str, checkpoint: str, delay: str):
    """Appends every article once, scored, to a table of files; repeats within ``delay`` are dropped as they come."""
    return (score_articles(watched(stream, delay)).writeStream.format("parquet").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
