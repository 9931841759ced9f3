"""Problem-type inference, complete cases and an exact, repeatable stratified split."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._cols import q
from ..functions.aggs import is_missing
from ..functions.ranking import cumulative
from ..functions.schema import is_numeric_type

SEED = 42


def problem_type(df: DataFrame, columns) -> DataFrame:
    """H1: (column, n_unique, all_integer, problem) for candidate targets.

    Missing values (NULL, NaN) do not count. Text -> classification; at most 10 distinct integer-valued numbers ->
    classification; anything else -> regression.
    """
    rows = []
    for c in columns:
        dt = df.schema[c].dataType
        present = F.when(~is_missing(df, c), F.col(q(c)))
        if not is_numeric_type(dt):
            rows.append((c, F.count_distinct(present), F.lit(None).cast("boolean"), True))
        else:
            x = present.cast("double")
            rows.append((c, F.count_distinct(present),
                         F.coalesce(F.bool_and(F.when(x.isNotNull(), x == F.floor(x))), F.lit(True)), False))
    one = df.agg(*[e.alias(f"u{i}") for i, (_, e, _, _) in enumerate(rows)],
                 *[e.alias(f"i{i}") for i, (_, _, e, _) in enumerate(rows)])
    out = None
    for i, (c, _, _, is_text) in enumerate(rows):
        prob = (F.lit("classification") if is_text else
                F.when((F.col(f"u{i}") <= 10) & F.col(f"i{i}"), "classification").otherwise("regression"))
        part = one.select(F.lit(c).alias("column"), F.col(f"u{i}").cast("bigint").alias("n_unique"),
                          F.col(f"i{i}").alias("all_integer"), prob.alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


def complete_cases(df: DataFrame, features, target) -> DataFrame:
    """H2: features + target, rows with any missing value dropped."""
    cols = list(features) + [target]
    return df.select(*[F.col(q(c)) for c in cols]).dropna()


def stratified_split(df: DataFrame, label: str | None, test_fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """H3: add ``split`` ('train'/'test'): per class the first ceil(f * n_c) rows in hash order are test.

    The order is xxhash64(seed, row) then the row itself, a total order up to
    identical rows, so the split is exact and repeatable. Ranks come from the
    range-partitioned running count (no class is ever sorted in one task). Rows with
    a NULL label are a class of their own.
    """
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must be in (0, 1)")
    cols = [F.col(q(c)) for c in df.columns]
    keyed = df.select("*", F.xxhash64(F.lit(seed), *cols).alias("_h"), F.lit(1).alias("_one"))
    part = [label] if label else []
    if label:
        keyed = keyed.withColumn("_lbl", F.col(q(label)))
        part = ["_lbl"]
    ranked = cumulative(keyed, part, ["_h", *[c for c in df.columns]], ["_one"])
    n_test = F.ceil(F.col("total__one") * F.lit(test_fraction))
    out = ranked.withColumn("split", F.when(F.col("cum__one") <= n_test, "test").otherwise("train"))
    return out.drop("_h", "_one", "_lbl", "cum__one", "total__one")


def fold_assignment(df: DataFrame, label: str | None, k: int, seed: int = SEED) -> DataFrame:
    """H13 folds: rank within class in hash order, fold = rank mod k (stratified, repeatable)."""
    cols = [F.col(q(c)) for c in df.columns]
    keyed = df.select("*", F.xxhash64(F.lit(seed + 1), *cols).alias("_h"), F.lit(1).alias("_one"))
    part = []
    if label:
        keyed = keyed.withColumn("_lbl", F.col(q(label)))
        part = ["_lbl"]
    ranked = cumulative(keyed, part, ["_h", *[c for c in df.columns]], ["_one"])
    return ranked.withColumn("fold", ((F.col("cum__one") - 1) % k).cast("int")).drop(
        "_h", "_one", "_lbl", "cum__one", "total__one")
