"""Accuracy of parser and matcher on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round4
from ..functions.similarity import SCORERS
from ..functions.staging import materialize
from ..functions.text import same_label
from . import matching, parsing


def _ratio(hits, total):
    return F.coalesce(round4(F.coalesce(F.sum(hits.cast("long")), F.lit(0)) / F.nullif(total, F.lit(0))), F.lit(0.0))


def parser_cases(labelled: DataFrame) -> DataFrame:
    """Predictions beside (raw_input, expected_artist, expected_title, expected_pattern)."""
    rows = parsing.parse(labelled)
    rows = rows.withColumns(
        {
            "artist_matched": same_label(F.col("artist"), F.col("expected_artist")),
            "title_matched": same_label(F.col("title"), F.col("expected_title")),
            "pattern_matched": F.col("pattern").eqNullSafe(F.col("expected_pattern")),
        }
    )
    return rows.withColumn("exact_matched", F.col("artist_matched") & F.col("title_matched") & F.col("pattern_matched"))


def evaluate_parser(labelled: DataFrame) -> DataFrame:
    """One row of accuracies, zeros for no rows."""
    names = ("artist", "title", "pattern", "exact")
    n = F.count("*")
    return parser_cases(labelled).agg(n.alias("total"), *(_ratio(F.col(f"{x}_matched"), n).alias(f"{x}_accuracy") for x in names))


def matcher_cases(
    examples: DataFrame, catalogs: list[tuple[str, DataFrame]], scorer: str = "levenshtein", k: int = 3, margin: float = 0.05, found: DataFrame | None = None
) -> DataFrame:
    """Per (line_id, query, expected_track_id): retrieval by the hybrid score, then ranked by
    ``scorer``; top-1 and top-k hits, the margin to the runner-up and whether it is ambiguous."""
    found = matching.search(examples.select("line_id", "query"), catalogs, k) if found is None else found
    texts = found.select(F.col("normalized_query").alias("a"), F.col("normalized_candidate").alias("b")).distinct()
    scored = SCORERS[scorer](texts).withColumnsRenamed({"a": "normalized_query", "b": "normalized_candidate"})
    pairs = found.drop("score", "distance").withColumnRenamed("rank", "found_rank").join(scored, ["normalized_query", "normalized_candidate"])
    order = matching.Window.partitionBy("line_id").orderBy(F.col("score").desc(), F.col("distance"), F.col("display_text").desc(), "provider_ord", "found_rank")
    top = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = top.groupBy("line_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("track_id"))).alias("top_1"),
        F.collect_set("track_id").alias("top_k"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    rows = examples.join(best, "line_id", "left")
    gap = round4(F.greatest(F.coalesce("s1", F.lit(0.0)) - F.coalesce("s2", F.lit(0.0)), F.lit(0.0)))
    rows = rows.select(
        "line_id",
        "query",
        "expected_track_id",
        F.coalesce(F.col("top_1") == F.col("expected_track_id"), F.lit(False)).alias("top_1_matched"),
        F.coalesce(F.array_contains("top_k", F.col("expected_track_id")), F.lit(False)).alias("top_k_matched"),
        F.coalesce("s1", F.lit(0.0)).alias("top_1_score"),
        F.coalesce("s2", F.lit(0.0)).alias("runner_up_score"),
        gap.alias("score_margin"),
        F.col("s2").isNotNull().alias("_two"),
    )
    return rows.withColumn("is_ambiguous", F.col("_two") & (F.col("score_margin") <= margin)).drop("_two")


def evaluate_matcher(
    examples: DataFrame, catalogs: list[tuple[str, DataFrame]], scorer: str = "levenshtein", k: int = 3, margin: float = 0.05, found: DataFrame | None = None
) -> DataFrame:
    cases = matcher_cases(examples, catalogs, scorer, k, margin, found)
    n = F.count("*")
    return cases.agg(
        n.alias("total"),
        _ratio(F.col("top_1_matched"), n).alias("top_1_accuracy"),
        _ratio(F.col("top_k_matched"), n).alias("top_k_accuracy"),
        F.coalesce(F.count_if("is_ambiguous"), F.lit(0)).alias("ambiguous_count"),
    )


def compare_matchers(examples: DataFrame, catalogs: list[tuple[str, DataFrame]], k: int = 3, algorithms: list[str] | None = None) -> DataFrame:
    """One row of accuracies per algorithm, by name unless listed; all rank one retrieval."""
    rows = None
    found = materialize(matching.search(examples.select("line_id", "query"), catalogs, k), "found")
    for name in algorithms or sorted(SCORERS):
        one = evaluate_matcher(examples, catalogs, name, k, found=found).withColumn("algorithm", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def summary_text(report: DataFrame) -> DataFrame:
    """The report as one line of text per row, ratios with 4 decimals."""
    parts = [F.format_string(f"{c}=%.4f" if t == "double" else f"{c}=%s", F.col(c)) for c, t in report.dtypes]
    return report.select(F.concat_ws("\n", *parts).alias("summary"))
