"""Cleaning: keys, casts, encodings, imputation, bins, rescaling, column quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloscope.functions import fixed_values as V
from discloscope.functions.exprs import clip, cut, finite, lookup, with_globals
from discloscope.functions.ranking import attach_group, column_quantiles, exact_quantiles, per_column
from discloscope.functions.text import strip_space


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job runs, naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def standard_name(c: Column) -> Column:
    return F.upper(strip_space(c))


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """First row per key in ingest order. ``min_by`` combines map-side, so repeated keys do not pile up."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(ordinal)).alias("r"))
    return first.select("r.*")


def parse_thousands(c: Column) -> Column:
    return _try_double(F.trim(F.replace(c, F.lit(","), F.lit(""))))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def first_number(c: Column) -> Column:
    return _try_double(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")))


def threshold_flag(c: Column, at: float = 0.5) -> Column:
    return F.coalesce((c >= at).cast("int"), F.lit(0))


def accusation_band(score: Column) -> Column:
    return cut(score, [0, 0.25, 0.5, 0.75, 1.0], ["Low", "Moderate", "High", "Very High"], include_lowest=True)


def total_bin(c: Column) -> Column:
    return cut(c, [0, 10, 20, 30, 40, float("inf")], [0, 1, 2, 3, 4], right=False, default=2)


def pillar_bin(c: Column) -> Column:
    return cut(c, [0, 3, 6, 10, 15, float("inf")], [0, 1, 2, 3, 4], right=False, default=2)


def spread(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols) - F.least(*cols)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def median_impute(df: DataFrame, columns: Sequence[str], base: DataFrame | None = None, medians: dict | None = None) -> DataFrame:
    """NULL becomes the exact column median; all medians come from one round over ``base``, the same rows from a narrower
    source, or are given as ``medians`` under the names ``<column>_p50``."""
    medians = column_quantiles(df if base is None else base, columns, {"p50": 0.5}) if medians is None else medians
    filled = with_globals(df, {f"{c}_p50": medians[f"{c}_p50"] for c in columns}, "_med")
    return filled.select(*[
        F.coalesce(F.col(c), F.col(f"_med.{c}_p50")).alias(c) if c in columns else F.col(c) for c in df.columns])


def impute_from_base(df: DataFrame, columns: Sequence[str], is_new: Column, base: Column) -> DataFrame:
    """Rows of the new source take medians computed on the base source only."""
    medians = column_quantiles(df.filter(base), columns, {"p50": 0.5})
    out = with_globals(df, medians, "_med")
    return out.select(*[
        F.when(is_new, F.col(f"_med.{c}_p50")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def scrub_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite and NULL become 0."""
    return df.select(*[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def nonfinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: infinities and missing values before the scrub."""
    inf = F.lit(float("inf"))
    return per_column(df, columns, lambda c: {
        "n_infinite": F.count_if(F.abs(F.col(c)) == inf), "n_missing": F.count_if(F.col(c).isNull() | F.isnan(F.col(c)))})


def grade_levels(df: DataFrame, grade: str) -> DataFrame:
    return df.withColumns({
        "controversy_proxy": lookup(V.GRADE_CONTROVERSY, F.col(grade), 2),
        "esg_risk_level_proxy": lookup(V.GRADE_RISK, F.col(grade), 2)})


def inverted_rescale(df: DataFrame, ranges: dict[str, tuple[float, float]], target: float = 50.0) -> DataFrame:
    """Higher-is-better scores onto the 0..target risk scale."""
    return df.withColumns({
        f"{c}_normalized": clip(target - (F.col(c) - float(lo)) / float(hi - lo) * target, 0, target)
        for c, (lo, hi) in ranges.items()})


def entity_filter(df: DataFrame, sector: str | None = None, tier: str | None = None,
                  low: float | None = None, high: float | None = None, score: str = "risk_score") -> DataFrame:
    """Each filter is skipped at None; Catalyst pushes what remains to the scan."""
    if sector is not None:
        df = df.filter(F.col("sector") == sector)
    if tier is not None:
        df = df.filter(F.col("risk_tier") == tier)
    if low is not None:
        df = df.filter(F.col(score) >= low)
    if high is not None:
        df = df.filter(F.col(score) <= high)
    return df


def key_lookup_fill(df: DataFrame, known: DataFrame, key: str, value: str, ordinal: str, default: str) -> DataFrame:
    """Missing ``value`` from pairs seen in ``known``; the last pair in ingest order wins."""
    pairs = (known.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
             .groupBy(F.upper(key).alias("_key"))
             .agg(F.max_by(F.col(value), F.col(ordinal)).alias("_found")))
    out = attach_group(df.withColumn("_key", F.upper(key)), pairs, ["_key"])
    current = F.col(value) if value in df.columns else F.lit(None).cast("string")
    return out.withColumn(value, F.coalesce(current, F.col("_found"), F.lit(default))).drop("_key", "_found")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_constant): at most one distinct non-NULL value, by min = max."""
    return per_column(df, columns, lambda c: {"is_constant": F.coalesce(F.min(c) == F.max(c), F.lit(True))})


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = constant_columns(df, columns).filter("is_constant").collect()  # at most one row per column
    return df.drop(*[r["column"] for r in row])


def duplicate_columns(df: DataFrame, row_id: str, columns: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs (kept, later copy) equal on every row.

    One pass fingerprints every column; only columns whose fingerprints collide are
    compared value by value, in one more pass.
    """
    found = per_column(df, columns, lambda c: {"print": F.bit_xor(F.xxhash64(F.col(row_id), F.col(c).cast("double")))})
    prints = {r["column"]: r["print"] for r in found.collect()}  # one row per column
    by_print: dict[int, list[str]] = {}
    for c in columns:
        by_print.setdefault(prints[c], []).append(c)
    suspects = [(g[i], g[j]) for g in by_print.values() for i in range(len(g)) for j in range(i + 1, len(g))]
    return equal_pairs(df, suspects)


def equal_pairs(df: DataFrame, suspects: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs of columns that are equal on every row, from one pass."""
    if not suspects:
        return []
    same = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in suspects]).first()
    return [(a, b) for a, b in suspects if same[f"{a}|{b}"] == 0]


def group_quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    ends = df.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    quart = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ends.join(quart, group, "left")
