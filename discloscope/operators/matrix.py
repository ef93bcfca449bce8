"""The wide feature matrix: packs, quality pass, correlated pairs, registry, sink."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from discloscope.operators import categorical as K
from discloscope.operators import cleaning as C
from discloscope.operators import nlp as N
from discloscope.operators import numeric as M
from discloscope.operators.profile import Profile, column_profile
from discloscope.session import materialize

MODULES = {"numerical": M.ALL_FEATURES, "nlp": N.ALL_FEATURES, "categorical": K.ALL_FEATURES}
DECLARED = [(f, m) for m, fs in MODULES.items() for f in fs]


def build(plain: DataFrame, texts: DataFrame, key: str = "company_id", scaled: bool = False) -> DataFrame:
    """All packs: numeric and categorical ones on the narrow ``plain``, text packs on ``texts`` (key and description).

    Only the narrow side is staged before the packs, spread by key, as its scan may have few splits, or one that holds most
    rows; texts are read once, from their scan, and the two halves meet in one join on the key.
    """
    base = materialize(plain.repartition(key))
    numbers = K.all_categorical(M.all_numeric(base, scaled=scaled), key, base)
    return materialize(numbers.join(N.all_nlp(texts).drop("description"), key))


def quality_pass(matrix: DataFrame, key: str = "company_id") -> tuple[DataFrame, list[tuple[str, str]], Profile]:
    """Scrub non-finite values, then drop constant columns and later copies; returns what was dropped and why, and the
    profile of all features, which one sweep gives."""
    features = [f for f, _ in DECLARED if f in matrix.columns]
    doubles = [f.name for f in matrix.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name in features]
    clean = C.scrub_nonfinite(matrix, doubles)
    profile = column_profile(clean, key, features)
    constant = profile.constant()
    left = [f for f in features if f not in set(constant)]
    copies = sorted({b for _, b in C.equal_pairs(clean, profile.alike(left))})
    return clean.drop(*constant, *copies), [(c, "constant") for c in constant] + [(c, "duplicate") for c in copies], profile


def correlated(matrix: DataFrame, profile: Profile, above: float = 0.98) -> DataFrame:
    """Highly correlated pairs of the kept features; bounded by the column count."""
    kept = [f for f, _ in DECLARED if f in matrix.columns]
    return matrix.sparkSession.createDataFrame(profile.correlated(kept, above), "left string, right string, r double")


def registry(matrix: DataFrame, dropped: list[tuple[str, str]], profile: Profile) -> DataFrame:
    """Every declared feature with its module, status, type and, where kept, its statistics."""
    status, types, rows = dict(dropped), dict(matrix.dtypes), []
    for f, module in DECLARED:
        figures = (None,) * 5
        if f in types:
            c = profile.columns.loc[f]
            figures = tuple(None if pd.isna(c[x]) else float(c[x]) for x in ("mean", "std", "min", "max")) + (int(c["null_count"]),)
        rows.append((f, module, status.get(f, "kept"), types.get(f, "removed"), *figures))
    return matrix.sparkSession.createDataFrame(
        rows, "feature string, module string, status string, dtype string, mean double, std double, min double, max double, null_count long")
