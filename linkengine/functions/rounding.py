"""Rounding of exact binary values, half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _round4(f: Column) -> Column:
    """Round a double in [0, 1] to 4 decimals by its exact binary value.

    The product with 10000 is split without error (Veltkamp), so ties are seen as such.
    """
    t = F.lit(134217729.0) * f
    high = t - (t - f)
    q = f * 10000.0
    lost = (high * 10000.0 - q) + (f - high) * 10000.0
    k = F.floor(q).cast("double")
    d = (q - k - 0.5) + lost
    even = F.when(F.pmod(k, F.lit(2.0)) == 0, k).otherwise(k + 1)
    return F.when(d > 0, k + 1).when(d < 0, k).otherwise(even) / 10000.0


def with_round4(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``: ``value`` rounded to 4 decimals. The value is a column of its own
    first, so that it is computed once."""
    return df.withColumn("_raw", value).withColumn(name, _round4(F.col("_raw"))).drop("_raw")


def round4(value: Column) -> Column:
    """The same as one expression, for places off the hot path."""
    return F.get(F.transform(F.array(value), _round4), F.lit(0))


def round_half_even(value: Column) -> Column:
    return F.rint(value).cast("int")
