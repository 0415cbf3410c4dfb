"""Candidate search, scoring, ranking and matching.

Catalogs are (source, DataFrame) pairs in provider order; a catalog has track_id,
artist, title, external_url and cand_ord (its own order). Scores and ranks depend on normalised texts only, so
distinct texts are scored and cut to their k best once and only then meet the lines. A catalog whose counted rows and bytes
allow it is broadcast and every query scores every text of it; beyond that, ``topk_join`` finds the k best by equality
joins and upper bounds. Other joins are told to shuffle, since the size of their sides grows with the lines and Spark's
estimates, from compressed bytes, would let the driver build tables of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settle
from ..functions.staging import fits_broadcast, materialize
from ..functions.similarity import SCORERS
from ..functions.text import display_text, match_normalize
from ..functions.unicode import strip, truthy
from .topk_join import top_texts

BROADCAST_ROWS = 200_000
CANDIDATE_COLUMNS = ["source", "track_id", "artist", "title", "external_url", "provider_ord", "cand_ord"]


def is_small(df: DataFrame) -> bool:
    """Whether counts prove a written table small enough to be broadcast."""
    return fits_broadcast(df, BROADCAST_ROWS)


def union_catalogs(catalogs: list[tuple[str, DataFrame]]) -> DataFrame:
    """All providers' candidates in provider order, with the text that scorers compare."""
    parts = []
    for i, (source, catalog) in enumerate(catalogs):
        rows = catalog.withColumns({"source": F.lit(source), "provider_ord": F.lit(i)})
        if "external_url" not in catalog.columns:
            rows = rows.withColumn("external_url", F.lit(None).cast("string"))
        parts.append(rows.select(*CANDIDATE_COLUMNS))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("display_text", display_text(F.col("artist"), F.col("title")))
    return settle(rows, {"normalized_candidate": match_normalize(F.col("display_text"))})


def score_texts(queries: DataFrame, candidates: DataFrame, scorer: str) -> DataFrame:
    """(normalized_query, normalized_candidate, score, distance) of all distinct pairs; the candidates are broadcast."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer}; known: {', '.join(SCORERS)}")
    a = queries.select(F.col("normalized_query").alias("a")).distinct()
    b = candidates.select(F.col("normalized_candidate").alias("b")).distinct()
    pairs = a.repartition(F.col("a")).crossJoin(F.broadcast(b))
    return SCORERS[scorer](pairs).withColumnsRenamed({"a": "normalized_query", "b": "normalized_candidate"})


def with_normalized_query(queries: DataFrame, query: str = "query") -> DataFrame:
    return settle(queries, {"normalized_query": match_normalize(F.col(query))})


def _rank_order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("distance"), F.col("display_text").desc()]


def rank(queries: DataFrame, candidates: DataFrame, scorer: str = "hybrid", k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Scored candidates of (line_id, query) with ``rank`` from 1: score, then distance,
    then display text from the last, then the candidates' order."""
    queries = materialize(with_normalized_query(queries), "queries")
    candidates = materialize(candidates.withColumn("grp", F.concat_ws("\n", *(by or []))), "candidates")
    if is_small(candidates):
        found = score_texts(queries, candidates, scorer).join(F.broadcast(candidates), "normalized_candidate")
    else:
        offered = candidates.select("grp", F.col("normalized_candidate").alias("b"))
        scored = top_texts(queries.select(F.col("normalized_query").alias("a")), offered, scorer, k)
        scored = scored.withColumnsRenamed({"a": "normalized_query", "b": "normalized_candidate"})
        found = scored.join(candidates, ["grp", "normalized_candidate"])
    found = found.drop("grp")
    # No column of a line takes part in the order, so equal queries share one ranking.
    order = Window.partitionBy("normalized_query", *(by or [])).orderBy(*_rank_order(), "provider_ord", "cand_ord")
    found = found.withColumns({"rank": F.row_number().over(order), "algorithm": F.lit(scorer)})
    found = found.filter(F.col("rank") <= k) if k is not None else found
    return queries.join(found.hint("merge"), "normalized_query")


def search(queries: DataFrame, catalogs: list[tuple[str, DataFrame]], limit_per_source: int = 10, scorer: str = "hybrid") -> DataFrame:
    """The best candidates per source of every non-blank query, one row per (source, id)."""
    if not 1 <= limit_per_source <= 50:
        raise ValueError("limit_per_source must be between 1 and 50")
    asked = queries.filter(strip(F.coalesce(F.col("query"), F.lit(""))) != "")
    found = rank(asked, union_catalogs(catalogs), scorer, limit_per_source, by=["source"])
    first = Window.partitionBy("line_id", "source", "track_id").orderBy("provider_ord", "rank")
    return found.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")


def from_services(candidates: DataFrame, after: int = 0) -> DataFrame:
    """Candidates that services returned for each line, as ``search`` returns them; their
    sources follow ``after`` catalogs."""
    rows = candidates.withColumns({"provider_ord": F.col("provider_ord") + after, "rank": F.col("cand_ord") + 1})
    rows = rows.withColumn("display_text", display_text(F.col("artist"), F.col("title")))
    return settle(rows, {"normalized_candidate": match_normalize(F.col("display_text"))})


def source_reports(queries: DataFrame, found: DataFrame, sources: list[str], failed: dict[str, str] | None = None) -> DataFrame:
    """(line_id, source, status, candidate_count, error_code) with zero counts kept."""
    spark = queries.sparkSession
    failed = failed or {}
    asked = queries.filter(strip(F.coalesce(F.col("query"), F.lit(""))) != "").select("line_id")
    table = spark.createDataFrame([(i, s, failed.get(s)) for i, s in enumerate(sources)], "provider_ord int, source string, error_code string")
    counts = found.groupBy("line_id", "source").agg(F.count("*").alias("n"))
    rows = asked.crossJoin(F.broadcast(table)).join(counts, ["line_id", "source"], "left")
    status = F.when(F.col("error_code").isNull(), "success").otherwise("failed")
    return rows.select("line_id", "source", status.alias("status"), F.coalesce("n", F.lit(0)).alias("candidate_count"), "error_code")


def search_query(artist: Column, title: Column, normalized: Column) -> Column:
    """The text a parsed row is searched by."""
    fields = F.concat(artist, F.lit(" - "), title)
    return F.when(truthy(artist) & truthy(title), fields).when(truthy(title), title).otherwise(normalized)


def match_candidates(variants: DataFrame, found: DataFrame, k: int | None = None, scorer: str = "hybrid") -> DataFrame:
    """Best match per (line, source, track id) over all variants, ranked from 1.

    ``variants`` has (line_id, query_variants); ``found`` the candidates of each line. Between
    variants the higher score, variant confidence and smaller distance win, then the
    earlier variant.
    """
    exploded = variants.select("line_id", F.posexplode("query_variants").alias("variant_ord", "v"))
    exploded = exploded.select("line_id", "variant_ord", F.col("v.text").alias("query"), F.col("v.source").alias("query_variant_source"), F.col("v.confidence").alias("query_variant_confidence"))
    candidates = found.select("line_id", *CANDIDATE_COLUMNS, "display_text", "normalized_candidate", F.col("rank").alias("found_rank"))
    pairs = materialize(with_normalized_query(exploded).join(candidates.hint("merge"), "line_id"), "pairs")
    texts = pairs.select(F.col("normalized_query").alias("a"), F.col("normalized_candidate").alias("b")).distinct()
    scored = SCORERS[scorer](texts).withColumnsRenamed({"a": "normalized_query", "b": "normalized_candidate"})
    pairs = pairs.join(scored.hint("merge"), ["normalized_query", "normalized_candidate"]).withColumn("algorithm", F.lit(scorer))
    better = [F.col("score").desc(), F.col("query_variant_confidence").desc(), F.col("distance")]
    best = Window.partitionBy("line_id", "source", "track_id").orderBy(*better, "variant_ord", "found_rank")
    pairs = pairs.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best")
    # The order of first insertion: that of the first variant's ranking, which no column
    # above can tell apart, ends in provider and candidate order.
    order = Window.partitionBy("line_id").orderBy(*better, F.col("display_text").desc(), "variant_ord", "provider_ord", "cand_ord")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked
