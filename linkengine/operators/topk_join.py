"""Lossless top-k similarity join of texts.

A rank-k answer may have any score, so no fixed threshold may prune. What prunes is each query's own k-th best
score: pairs are met in bands of falling upper bounds, and a query leaves as soon as its k-th best score is not below the
band, because no pair that it has not met can then be among its k best, ties included.

Upper bounds come from lengths, characters shared (with repeats) and the common prefix (``similarity.upper_bound``). They are taken
twice. Candidates lie in cells of one length, first character and number of characters in each of ``CLASSES`` classes; a query
meets only the cells that can reach the band, found by an equality join on length over distinct signatures. Then each pair of a
query and a member of its cells gets its own bound from the exact counts, and is scored only if that reaches the band and the
query's floor, its k-th best score so far. Every pair belongs to one band, so none is scored twice.

All joins are equality joins, which shuffle and split where skewed; what is small is broadcast by its measured size. Between bands, what
was found is written, so lineage stays short. A query whose best scores are low meets the more candidates; one that has fewer
candidates than k meets all of its group, as they are all part of the answer.

Cases: null texts are neither queries nor candidates. Repeated texts are one text here. Empty texts score 1 with each other and
0 with others. Ties at the k-th score are all returned. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settle
from ..functions.similarity import SCORERS, WEIGHTS, common_prefix, upper_bound
from ..functions.staging import materialize

#: Lower ends of the bands. The last must be 0.
BANDS = (0.8, 0.5, 0.0)
#: Character classes of a cell.
CLASSES = 4
#: How far rounding can lift a score above its bound: three roundings to 4 decimals.
SLACK = 2e-4


def _features(rows: DataFrame, text: str) -> DataFrame:
    """Length, first character, characters per class and the numbered characters (code point and how many equal
    ones come before) of a text, which make an intersection of sets count repeats."""
    chars = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(text), ""))
    rows = settle(rows, {"chars": F.transform(chars, F.ascii)})
    numbered = F.transform("chars", lambda c, i: c.cast("long") * (1 << 32) + F.size(F.filter(F.slice("chars", 1, i + 1), lambda x: x == c)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda g: F.size(F.filter("chars", lambda c: c % CLASSES == g)))
    rows = settle(rows, {"len": F.size("chars"), "head": F.coalesce(F.get("chars", F.lit(0)), F.lit(-1)), "counts": counts, "marks": numbered})
    return rows.drop("chars")


def _least_ratio(weights: tuple[float, float], band: float) -> float:
    """The least ratio of lengths, shorter to longer, of a pair that reaches the band: the bound with the shorter
    text wholly shared and a full common prefix is linear in it."""
    at = lambda r: weights[0] * r + weights[1] * (0.6 * (r + 2) / 3 + 0.4)
    low, high = at(0.0), at(1.0)
    return min(1.0, max(0.0, (band - SLACK - low) / (high - low)))


def top_texts(queries: DataFrame, candidates: DataFrame, scorer: str, k: int | None) -> DataFrame:
    """(grp, a, b, score, distance) of pairs of distinct texts, with at least the k best of each query ``a`` in
    each group ``grp`` of the candidates (grp, b), ties included; all pairs without ``k``.

    Every query is asked in every group. Groups are sources, a few.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer}; known: {', '.join(SCORERS)}")
    weights = WEIGHTS.get(scorer)
    bands = BANDS if weights and k is not None else (0.0,)
    cells = ["grp", "len_b", "head_b", "counts_b"]
    index = _features(candidates.select("grp", "b").filter(F.col("b").isNotNull()).distinct(), "b")
    index = materialize(index.withColumnsRenamed({c: f"{c}_b" for c in ("len", "head", "counts", "marks")}), "index")
    groups = {r["grp"]: (r["n"], r["longest"]) for r in index.groupBy("grp").agg(F.count("*").alias("n"), F.max("len_b").alias("longest")).collect()}  # a row for each source
    work = _features(queries.select("a").filter(F.col("a").isNotNull()).distinct(), "a")
    asked = F.explode(F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(n if k is None else min(k, n)).alias("need"), F.lit(longest).alias("longest")) for g, (n, longest) in groups.items())))
    work = work.select("*", asked.alias("_g")).select("*", "_g.*").drop("_g") if groups else work.withColumns({"grp": F.lit(""), "need": F.lit(0), "longest": F.lit(0)}).limit(0)
    work = materialize(work.withColumn("floor", F.lit(0.0)), "asked")
    found, above = None, 2.0
    for band in bands:
        scored = materialize(_band(work, index, cells, scorer, weights, band, above), "scored")
        found = scored if found is None else found.unionByName(scored)
        if band == bands[-1]:
            break
        place = F.row_number().over(Window.partitionBy("grp", "a").orderBy(F.col("score").desc()))
        floors = found.withColumn("place", place).join(work.select("grp", "a", "need"), ["grp", "a"]).filter(F.col("place") == F.col("need"))
        floors = floors.select("grp", "a", F.col("score").alias("kth"))
        # Whoever has k scores not below the band is done; others go on, with what they have as their floor.
        work = work.join(floors, ["grp", "a"], "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(0.0)))).filter(F.coalesce("kth", F.lit(-1.0)) < band)
        work = materialize(work.drop("kth"), "asked")
        above = band
        if work.isEmpty():
            break
    return found


def _bound(shared: Column, prefix: Column, la: str, lb: str, weights: tuple[float, float] | None) -> Column:
    return upper_bound(shared, F.col(la), F.col(lb), prefix, *weights) + SLACK if weights else F.lit(1.0)


def _band(work: DataFrame, index: DataFrame, cells: list[str], scorer: str, weights: tuple[float, float] | None, band: float, above: float) -> DataFrame:
    """Scores of the pairs whose bound lies in the band and reaches the query's floor."""
    signature = ["grp", "len", "head", "counts"]
    ratio = _least_ratio(weights, band) if weights else 0.0
    low = F.ceil(F.col("len") * ratio).cast("int")
    high = F.least(F.floor(F.col("len") / ratio).cast("int"), F.col("longest")) if ratio > 0 else F.col("longest")
    wide = work.groupBy(*signature).agg(F.max("longest").alias("longest")).filter(low <= high)
    wide = wide.withColumn("len_b", F.explode(F.sequence(low, high))).drop("longest")
    near = wide.join(index.select(*cells).distinct(), ["grp", "len_b"])
    in_class = F.zip_with("counts", "counts_b", lambda x, y: F.least(x, y))
    shared = F.aggregate(in_class, F.lit(0), lambda n, x: n + x)
    near = near.filter(_bound(shared, F.when(F.col("head") == F.col("head_b"), 4).otherwise(0), "len", "len_b", weights) >= band)
    # Queries are few bytes but much work, so they are spread by number, not by size.
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = work.select(*signature, "a", "marks", "floor").repartition(parts, "grp", "a").join(near, signature).join(index, cells)
    exact = F.size(F.array_intersect("marks", "marks_b"))
    pairs = settle(pairs, {"bound": _bound(exact, common_prefix(F.col("a"), F.col("b")), "len", "len_b", weights)})
    pairs = pairs.filter((F.col("bound") >= F.greatest(F.lit(band), F.col("floor"))) & (F.col("bound") < above))
    return SCORERS[scorer](pairs.select("grp", "a", "b")).select("grp", "a", "b", "score", "distance")
