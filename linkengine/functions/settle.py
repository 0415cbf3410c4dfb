"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` behind a one-row generator.

    The optimizer inlines projected expressions into the filters and projections above
    them; over a chain of stages this multiplies both the plan and the work. It does
    not look through a generator, so what is settled is evaluated once per row.
    """
    kept = [c for c in df.columns if c not in columns]
    rows = df.select(*kept, F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_settled"))
    return rows.select(*kept, *(F.col("_settled")[k].alias(k) for k in columns))
