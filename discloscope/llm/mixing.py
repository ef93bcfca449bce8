"""Temperature mixing of sources, realised as block permutations under a token budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import prefix_positions, without
from discloscope.session import materialize

BISECTIONS = 60


def word_count(text: Column) -> Column:
    """Tokens of a text: maximal runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and made to sum to one."""
    raised = {s: p ** exponent for s, p in shares.items()}
    total = math.fsum(raised.values())
    return {s: x / total for s, x in raised.items()}


def fit_exponent(shares: dict[str, float], target_entropy: float | None, max_repeats: float | None, budget_share: float) -> float:
    """Largest exponent in [0, 1] whose weights reach the entropy, then raised until no source repeats too often.

    ``target_entropy`` is a part of the largest possible entropy, from 0 to 1. A source repeats
    weight * ``budget_share`` / share times; at exponent 1 all repeat ``budget_share`` times. Entropy falls and the
    most repeats fall as the exponent grows, so each limit is found by bisection; the repetition limit wins.
    """
    def entropy(a: float) -> float:
        return -math.fsum(w * math.log(w) for w in tempered(shares, a).values() if w > 0) / (math.log(len(shares)) or 1.0)

    def repeats(a: float) -> float:
        return max(w * budget_share / shares[s] for s, w in tempered(shares, a).items())

    exponent = 1.0
    if len(shares) > 1 and target_entropy is not None and entropy(1.0) < target_entropy:
        low, high = 0.0, 1.0
        for _ in range(BISECTIONS):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= target_entropy else (low, mid)
        exponent = low
    if len(shares) > 1 and max_repeats is not None and repeats(exponent) > max_repeats:
        low, high = exponent, 1.0
        for _ in range(BISECTIONS):
            mid = (low + high) / 2
            low, high = (low, mid) if repeats(mid) <= max_repeats else (mid, high)
        exponent = high
    return exponent


def mix_sources(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 2.0, budget_share: float = 1.0,
                blocks: int = 64, max_sources: int = 10_000, source: str = "source", text: str = "text") -> DataFrame:
    """Rows of the mixture: all columns of ``docs`` with ``tokens``, ``epoch``, ``block`` and ``block_order``.

    The budget is ``budget_share`` times the tokens of all documents. Token shares of the sources are raised to the
    exponent of ``fit_exponent`` and normalised; a source's quota is its weight times the budget, in whole tokens.
    The documents of a source stand in a fixed permutation (an MD5 of the id) that is repeated, and a copy is used
    while the tokens before it are under the quota. Its place in the quota gives its block, so every block of the
    budget holds the sources at their weights, and ``block_order`` permutes the block. Nothing depends on the
    layout of the input: the same rows give the same mixture.

    A null source is a source of its own. Texts that are null or without tokens weigh nothing, so they are used
    once, with the first epoch, if the quota is not empty. Rows that agree in id, source and text are one unit with
    their joint tokens. No tokens at all, or no rows, give no rows. More than ``max_sources`` sources raise an
    error, as one row for each goes to the driver. Input columns that clash with the added names give way.
    """
    docs = without(docs, "tokens", "epoch", "block", "block_order", "_row", "_cell")
    named = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    key = F.xxhash64("doc_id", named, text)
    # texts are counted once; all that follows works on this narrow table
    units = materialize(docs.select(key.alias("_row"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_md5"),
                                    named.alias("_source"), word_count(F.col(text)).alias("tokens"))
                        .groupBy("_row", "_md5", "_source", "tokens").agg((F.count(F.lit(1)) * F.col("tokens")).alias("_weight")))
    rows = units.groupBy("_source").agg(F.sum("_weight").alias("n")).filter("n > 0").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["_source"]: r["n"] for r in rows}
    total = sum(sizes.values())
    shares = {s: n / total for s, n in sizes.items()}
    weights = tempered(shares, fit_exponent(shares, target_entropy, max_repeats, budget_share)) if shares else {}
    plan = docs.sparkSession.createDataFrame(
        [(s, sizes[s], round(w * budget_share * total)) for s, w in sorted(weights.items())], "_source string, _size long, _quota long")

    # three hex digits of the permutation's key cut a source into 4,096 cells
    ranked = prefix_positions(units, "_source", F.substring("_md5", 1, 3), [F.col("_md5"), F.col("_row")], "_through", weight="_weight")
    ranked = ranked.join(F.broadcast(plan), "_source")
    before, quota, whole = F.col("_through") - F.col("_weight"), F.col("_quota"), F.col("_size")
    # full passes over the source, and one more copy for what lies before the rest of the quota
    copies = ((quota - quota % whole) / whole).cast("long") + F.when(before < quota % whole, 1).otherwise(0)
    copies = F.when(F.col("tokens") == 0, F.least(copies, F.lit(1))).otherwise(copies)
    ranked = ranked.withColumn("_copies", copies).filter("_copies > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    used = ranked.select("_row", "tokens", F.col("epoch").cast("int").alias("epoch"),
                         F.least(F.floor((F.col("epoch") * whole + before) / quota * blocks), F.lit(blocks - 1)).cast("int").alias("block"),
                         F.md5(F.concat_ws("/", F.col("epoch"), F.col("_md5"))).alias("block_order"))
    return docs.withColumn("_row", key).join(used, "_row").select(*docs.columns, "tokens", "epoch", "block", "block_order")
