"""Similarity of two normalised texts.

A scorer takes a DataFrame with columns ``a`` and ``b`` and adds ``score`` (0 to 1,
rounded to 4 decimals) and ``distance``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import round4, round_half_even, with_round4
from .settle import settle

#: The prefix bonus of Jaro-Winkler and the weights of the hybrid score.
PREFIX_SCALE, MAX_PREFIX = 0.1, 4
LEVENSHTEIN_WEIGHT, JARO_WINKLER_WEIGHT = 0.35, 0.65


#: Characters compared at once, rows times length.
_CELLS = 1 << 20


def _jaro_udf():
    """Jaro similarity over Arrow batches, all pairs of a batch at once.

    The loop runs over the positions of the left texts; in each, every pair takes the first
    free equal character of its window. The function is local, so that it reaches
    executors by value.
    """

    def codes(texts: np.ndarray, width: int) -> np.ndarray:
        return texts.astype(f"<U{width}").view(np.uint32).reshape(len(texts), width)

    def jaro(left: np.ndarray, right: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        wa, wb = int(la.max()), int(lb.max())
        a, b = codes(left, wa), codes(right, wb)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        place = np.arange(wb)
        free = place < lb[:, None]
        matched = np.zeros(a.shape, dtype=bool)
        for i in range(wa):
            low, high = max(0, i - int(reach.max())), min(wb, i + int(reach.max()) + 1)
            if low >= high:
                break
            near = (np.abs(place[low:high] - i) <= reach[:, None]) & free[:, low:high] & (b[:, low:high] == a[:, i : i + 1]) & (la > i)[:, None]
            first = near.argmax(axis=1)
            hit = np.nonzero(near[np.arange(len(a)), first])[0]
            matched[hit, i] = True
            free[hit, low + first[hit]] = False
        taken = (place < lb[:, None]) & ~free
        m = matched.sum(axis=1)
        width = int(m.max())
        of = lambda mask, x: np.take_along_axis(x, np.argsort(~mask, axis=1, kind="stable")[:, :width], axis=1)
        t = ((of(matched, a) != of(taken, b)) & (np.arange(width) < m[:, None])).sum(axis=1) / 2
        some = np.maximum(m, 1)
        return np.where(m > 0, (m / la + m / lb + (m - t) / some) / 3, 0.0)

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        left, right = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
        known = np.array([x is not None and y is not None for x, y in zip(left, right)], dtype=bool)
        same = known & np.array([x == y for x, y in zip(left, right)], dtype=bool)
        la, lb = (np.array([len(x) if x is not None else 0 for x in side], dtype=np.int64) for side in (left, right))
        out[known] = 0.0
        out[same] = 1.0
        rows = np.nonzero(known & ~same & (la > 0) & (lb > 0))[0]
        rows = rows[np.argsort(np.maximum(la, lb)[rows], kind="stable")]
        at = 0
        while at < len(rows):
            # Rows of about one length at a time; the longest of them sets the width.
            n = max(1, min(len(rows) - at, _CELLS // int(max(la[rows[at]], lb[rows[at]]))))
            while n > 1 and n * int(max(la[rows[at + n - 1]], lb[rows[at + n - 1]])) > 2 * _CELLS:
                n = n // 2
            part = rows[at : at + n]
            out[part] = jaro(left[part], right[part], la[part], lb[part])
            at += n
        return pd.Series([None if np.isnan(x) else x for x in out.tolist()], dtype="float64")

    return of


#: Stand-ins in the fold of ``jaro``: a consumed character, and U+0000 of a text, which is compared as this non-character.
_CONSUMED, _NUL = "\u0000", "\U0010ffff"


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity as an expression; null if either text is.

    The fold runs over the characters of ``a``. Its state is where it is, what has matched so far and ``b``, with every character
    that was taken overwritten, so the first free equal character of the window is a plain search from the window's start.
    """
    left, right = (F.translate(s, _CONSUMED, _NUL) for s in (a, b))
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("matched"), right.alias("free"))

    def folded(x: Column, y: Column, window: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            at = F.call_function("locate", c, acc["free"], F.greatest(acc["i"] + 1 - window, F.lit(1)))
            hit = F.struct((acc["i"] + 1).alias("i"), F.concat(acc["matched"], c).alias("matched"), F.overlay(acc["free"], F.lit(_CONSUMED), at, F.lit(1)).alias("free"))
            return F.when(at.between(F.lit(1), acc["i"] + 1 + window), hit).otherwise(F.struct((acc["i"] + 1).alias("i"), acc["matched"].alias("matched"), acc["free"].alias("free")))

        def share(found: Column) -> Column:
            # The characters of b that were taken, in their order.
            taken = F.array_join(F.zip_with(F.split(found["free"], ""), F.split(y, ""), lambda f, c: F.when(f == _CONSUMED, c).otherwise("")), "")
            m = F.length(found["matched"])
            moved = F.size(F.filter(F.zip_with(F.split(found["matched"], ""), F.split(taken, ""), lambda u, v: u != v), lambda d: d)) / F.lit(2.0)
            return F.when(m == 0, 0.0).otherwise((m / F.length(x) + m / F.length(y) + (m - moved) / m) / 3)

        return F.get(F.transform(F.array(F.aggregate(F.split(x, ""), start, step)), share), F.lit(0))

    empty = (la == 0) | (lb == 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, 1.0).when(empty, 0.0).otherwise(folded(left, right, reach))


def common_prefix(a: Column, b: Column, most: int = MAX_PREFIX) -> Column:
    out = F.lit(0)
    for n in range(1, most + 1):
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
        out = F.when(same, n).otherwise(out)
    return out


def levenshtein(df: DataFrame) -> DataFrame:
    df = df.withColumn("distance", F.levenshtein("a", "b"))
    longest = F.greatest(F.length("a"), F.length("b"))
    return with_round4(df, "score", F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.col("distance") / longest))


def jaro_winkler_score(a: Column, b: Column) -> Column:
    """The rounded Jaro-Winkler score as an expression, for filters and join conditions; no Python worker."""
    boosted = lambda j: j + common_prefix(a, b) * F.lit(PREFIX_SCALE) * (F.lit(1.0) - j)
    return round4(F.get(F.transform(F.array(jaro(a, b)), boosted), F.lit(0)))


def jaro_winkler(df: DataFrame, prefix_scale: float = PREFIX_SCALE, max_prefix: int = MAX_PREFIX, native: bool = False) -> DataFrame:
    """The bonus applies at any similarity; the distance is of the unrounded score. ``native`` stays in the JVM, which is
    for few pairs or sessions without Python workers: whole Arrow batches are several times faster."""
    df = settle(df, {"_jaro": jaro(F.col("a"), F.col("b")) if native else _jaro_udf()(F.col("a"), F.col("b"))})
    prefix = common_prefix(F.col("a"), F.col("b"), max_prefix)
    df = df.withColumn("_jw", F.col("_jaro") + prefix * F.lit(prefix_scale) * (F.lit(1.0) - F.col("_jaro")))
    df = df.withColumn("distance", round_half_even((F.lit(1.0) - F.col("_jw")) * 10000))
    return with_round4(df, "score", F.col("_jw")).drop("_jaro", "_jw")


def hybrid(df: DataFrame, levenshtein_weight: float = LEVENSHTEIN_WEIGHT, jaro_winkler_weight: float = JARO_WINKLER_WEIGHT) -> DataFrame:
    """The weighted sum of both rounded scores; the distance is of the rounded sum."""
    total = levenshtein_weight + jaro_winkler_weight
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    df = levenshtein(df).withColumnRenamed("score", "_lev")
    df = jaro_winkler(df.drop("distance")).withColumnRenamed("score", "_jws").drop("distance")
    mixed = F.lit(levenshtein_weight / total) * F.col("_lev") + F.lit(jaro_winkler_weight / total) * F.col("_jws")
    df = with_round4(df, "score", mixed).drop("_lev", "_jws")
    return df.withColumn("distance", round_half_even((F.lit(1.0) - F.col("score")) * 10000))


def upper_bound(shared: Column, la: Column, lb: Column, prefix: Column, levenshtein_weight: float, jaro_winkler_weight: float) -> Column:
    """No pair scores more whose texts have these lengths, ``shared`` characters in common (with repeats) and a common
    prefix of at most ``prefix``: an edit script keeps at most the shared characters, and Jaro matches no others."""
    lev = shared / F.greatest(la, lb)
    jaro_most = (shared / la + shared / lb + 1.0) / 3.0
    jw = jaro_most + prefix * F.lit(PREFIX_SCALE) * (F.lit(1.0) - jaro_most)
    mixed = F.lit(levenshtein_weight) * lev + F.lit(jaro_winkler_weight) * jw
    return F.when((la == 0) & (lb == 0), 1.0).when(shared == 0, 0.0).otherwise(mixed)


#: Scorers by name; add an entry to plug in another.
SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hybrid": hybrid, "jaro_winkler": jaro_winkler, "levenshtein": levenshtein}
#: The weights of Levenshtein and Jaro-Winkler in a scorer, from which ``upper_bound`` follows. A scorer without an entry
#: is bounded by 1 only, so every pair is scored.
WEIGHTS: dict[str, tuple[float, float]] = {"hybrid": (LEVENSHTEIN_WEIGHT, JARO_WINKLER_WEIGHT), "jaro_winkler": (0.0, 1.0), "levenshtein": (1.0, 0.0)}
