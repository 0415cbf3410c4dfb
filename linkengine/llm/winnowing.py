"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in k-grams; of every window of w consecutive k-grams the least hash is
kept. Two texts that share a span of w + k - 1 words keep the same k-gram inside it, so
joining the kept k-grams of documents and benchmark items finds every such span. A hit
is extended word by word to both sides, as far as one guaranteed span can reach, and
counts if the shared run has the full length. The guarantee is set equal to the window
of the contract (10 words): k = 5, w = 6.

Items with fewer words than a window are one short window; their whole word sequence is
hashed, and documents are probed with all their grams of just these lengths.

Cases: a null or empty text has no words: ``n_words`` 0, no hits. Items without words
never match. Items with a null id mark words as hit but are not counted or listed.
Several rows with one item id are one item. Repeated document rows each get their own
result row. An empty benchmark gives documents without hits. Very long texts are read
whole; one of 2^27 words or more, whose positions would not fit, raises an error. Other columns pass
``drop_contaminated`` untouched and are ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, keyed, lookup_join, lower_az, materialize, row_key, unpacked

K = 5
W = 6
SPAN = K + W - 1
#: A kept k-gram packs 36 bits of hash over 27 bits of position.
_POSITION_BITS = 27
_HASH_MASK = (1 << 36) - 1
#: Benchmark k-grams are broadcast up to this counted number of rows, if their bytes fit too.
BROADCAST_GRAMS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _pack(value: Column, at: Column) -> Column:
    """Hash over position. A text of 2^27 words or more (some 800 MB) raises."""
    at = F.when(at < (1 << _POSITION_BITS), at).otherwise(F.raise_error(F.lit("a text has more words than positions")).cast("long"))
    return F.shiftleft(value.bitwiseAND(F.lit(_HASH_MASK)), _POSITION_BITS) + at


def _each(size: Column, span: int, f) -> Column:
    """f over the start positions of the spans of ``span`` within ``size`` elements."""
    starts = F.sequence(F.lit(0), size - span)
    return F.when(size >= span, F.transform(starts, f)).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_words(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``w``, the words. The generator keeps the optimizer from copying the split
    into every place that takes an element of ``w``."""
    return rows.withColumn("w", F.explode(F.array(words(text))))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Add ``prints``: packed (hash, position) of the k-grams of ``w`` that winnowing keeps."""
    w = F.col("w")
    grams = _each(F.size(w), K, lambda i: _pack(F.xxhash64(*(F.get(w, i + j) for j in range(K))), i.cast("long")))
    least = lambda g: _each(F.size(g), W, lambda i: F.least(*(F.get(g, i + j) for j in range(W))))
    changes = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
    return rows.withColumn("prints", _let(grams, lambda g: _let(least(g), changes)))


def short_grams(w: Column, n: int) -> Column:
    """Packed hashes of all grams of ``n`` words."""
    return _each(F.size(w), n, lambda i: _pack(F.xxhash64(F.lit(n), F.array_join(F.slice(w, i + 1, n), " ")), i.cast("long")))


def _around(w: Column, at: Column) -> Column:
    """The words of one k-gram and the ``W - 1`` on either side, nulls beyond the ends."""
    return F.array(*(F.get(w, at + d) for d in range(1 - W, K + W - 1)))


def benchmark_fingerprints(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, item_id, n, context): n is 0 for kept k-grams, else the words of a short item."""
    rows = with_words(benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text")), F.col("text"))
    rows = rows.select("item_id", "w").filter(F.size("w") > 0).distinct()
    full = with_fingerprints(rows.filter(F.size("w") >= SPAN)).select("item_id", "w", F.explode("prints").alias("p"))
    at = F.col("p").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    full = full.select(F.shiftright("p", _POSITION_BITS).alias("gram"), "item_id", F.lit(0).alias("n"), _around(F.col("w"), at).alias("context"))
    short = rows.filter(F.size("w") < SPAN)
    n = F.size("w")
    short_hash = F.xxhash64(n, F.array_join("w", " ")).bitwiseAND(F.lit(_HASH_MASK))
    short = short.select(short_hash.alias("gram"), "item_id", n.alias("n"), F.col("w").alias("context"))
    return full.union(short).distinct()


def _run(equal: list[Column]) -> Column:
    """How many of ``equal`` hold before the first that does not."""
    out = F.lit(len(equal))
    for i in reversed(range(len(equal))):
        out = F.when(equal[i], out).otherwise(F.lit(i))
    return out


def _verified(hits: DataFrame) -> DataFrame:
    """To (w, at, n, context) add ``first`` and ``end`` of the shared run, null if too short.

    The generator keeps the checks out of the filter that follows the join, which sees
    every k-gram and must stay small.
    """

    def verdict(near: Column) -> Column:
        same = [F.coalesce(F.get(near, F.lit(i)) == F.get("context", F.lit(i)), F.lit(False)) for i in range(K + 2 * (W - 1))]
        left, right = _run(same[: W - 1][::-1]), _run(same[K + W - 1 :])
        core = same[W - 1]
        for s in same[W : K + W - 1]:
            core = core & s
        full = (F.col("n") == 0) & core & (left + right + K >= SPAN)
        short = (F.col("n") > 0) & (near == F.col("context"))
        first = F.when(full, F.col("at") - left).when(short, F.col("at"))
        end = F.when(full, F.col("at") + K + right).when(short, F.col("at") + F.col("n"))
        return F.struct(first.alias("first"), end.alias("end"))

    near = F.when(F.col("n") == 0, _around(F.col("w"), F.col("at"))).otherwise(F.slice("w", F.col("at") + 1, F.greatest("n", F.lit(1))))
    run = F.when(F.col("n").isNotNull(), _let(near, verdict))
    hits = hits.withColumn("_run", F.explode(F.array(run)))
    return hits.withColumns({"first": F.col("_run.first"), "end": F.col("_run.end")}).drop("_run")


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(_id, _th, n_words, n_hit, items) for each document row; ``items`` is sorted."""
    bench = materialize(benchmark_fingerprints(benchmark), "benchmark")
    lengths = sorted(r["n"] for r in bench.filter("n > 0").select("n").distinct().collect())
    small = fits_broadcast(bench, BROADCAST_GRAMS)

    docs = with_words(documents.select(*row_key("doc_id", text), F.col(text).alias("text")), F.col("text")).select("_id", "_th", "w")
    probe = with_fingerprints(docs)
    parts = [F.array(F.lit(-1).cast("long")), F.col("prints"), *(short_grams(F.col("w"), n) for n in lengths)]
    probe = probe.withColumn("p", F.explode(F.concat(*parts)))
    at = F.col("p").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    probe = probe.select("_id", "_th", "w", F.shiftright("p", _POSITION_BITS).alias("gram"), at.alias("at"))
    is_row = F.col("gram") == -1
    if small:
        hits = probe.join(F.broadcast(bench), "gram", "left").filter(is_row | F.col("n").isNotNull())
        hits = _verified(hits)
    else:
        # Keys and positions alone meet the benchmark; only documents with hits come back.
        found = probe.drop("w").join(bench.hint("merge"), "gram").drop("gram")
        found = materialize(found.distinct(), "hits")
        again = docs.distinct().alias("d").join(found.alias("f").hint("merge"), F.expr("d._id <=> f._id and d._th = f._th"))
        found = _verified(again.select("d._id", "d._th", "w", "at", "n", "context", "item_id")).drop("w", "context")
        hits = probe.filter(is_row).withColumns({"n": F.lit(None).cast("int"), "item_id": F.lit(None).cast("string")})
        hits = hits.withColumns({"first": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
        hits = hits.unionByName(found.withColumns({"gram": F.lit(0).cast("long"), "w": F.lit(None).cast("array<string>")}), allowMissingColumns=True)
    kept = hits.filter(is_row | F.col("first").isNotNull()).select(
        "_id",
        "_th",
        F.when(is_row, F.size("w")).alias("n_words"),
        is_row.cast("long").alias("one"),
        F.when(~is_row, F.struct("first", "end")).alias("span"),
        F.when(~is_row, F.col("item_id")).alias("item_id"),
    )
    per_doc = kept.groupBy("_id", "_th").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("one").cast("int").alias("n_rows"),
        F.collect_set("span").alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["first"], acc["upto"]), F.lit(0))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    per_row = per_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return per_row.select("_id", "_th", "n_words", covered.alias("n_hit"), "items")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no benchmark window, with all their columns."""
    hit = contamination(documents, benchmark, text).filter("n_hit > 0").select("_id", "_th").distinct()
    hit = materialize(hit, "contaminated")
    on = F.expr("a._id <=> b._id and a._th = b._th")
    return lookup_join(keyed(documents, "doc_id", text).alias("a"), hit.alias("b"), on, "left_anti").select(*unpacked(documents.columns))
