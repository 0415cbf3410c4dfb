"""Statistics of lists, for all lists at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(items: DataFrame) -> DataFrame:
    """Per list: items, uncertain and confirmed ones, averages of non-null scores and confidences."""
    uncertain = F.count_if("is_uncertain")
    return items.groupBy("playlist_id").agg(
        F.count("*").alias("total_items"),
        uncertain.alias("uncertain_items"),
        (F.count("*") - uncertain).alias("confirmed_items"),
        F.avg("match_score").alias("avg_match_score"),
        F.avg("parser_confidence").alias("avg_parser_confidence"),
    )


def counts_by(items: DataFrame, column: str) -> DataFrame:
    """(playlist_id, column, n) with nulls left out."""
    return items.filter(F.col(column).isNotNull()).groupBy("playlist_id", column).agg(F.count("*").alias("n"))


def counts_map(items: DataFrame, column: str, name: str) -> DataFrame:
    rows = counts_by(items, column).groupBy("playlist_id")
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def uncertain_positions(items: DataFrame) -> DataFrame:
    marked = F.collect_list(F.when(F.col("is_uncertain"), F.col("position")))
    return items.groupBy("playlist_id").agg(F.array_sort(marked).alias("uncertain_positions"))


def list_stats(items: DataFrame) -> DataFrame:
    """One row per list with totals, both count maps and the uncertain positions."""
    out = totals(items).join(uncertain_positions(items), "playlist_id")
    out = out.join(counts_map(items, "source", "source_counts"), "playlist_id", "left")
    return out.join(counts_map(items, "match_algorithm", "algorithm_counts"), "playlist_id", "left")
