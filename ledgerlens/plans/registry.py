"""A tiny registry: query name -> (Spark builder, oracle SQL or None)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._cols import q
from ..functions.scalars import round_scaled

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def finalize(df: DataFrame, round_doubles: int | None = None) -> DataFrame:
    """Normalise result types for comparison: decimal/float -> double, integers -> bigint.

    ``round_doubles`` rounds floating results computed in a different order
    by different engines (means, deviations, correlations).
    """
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = c.cast("double")
            if round_doubles is not None:
                c = round_scaled(c, round_doubles)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
