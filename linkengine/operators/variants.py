"""Query variants of a parsed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round4
from ..functions.settle import settle
from ..functions.translit import to_latin
from ..functions.unicode import casefold, collapse, truthy

#: Canonical artists of known aliases, in order.
ALIASES = {
    "цой": ("кино", "kino"),
    "виктор цой": ("кино", "kino"),
    "tsoy": ("kino", "кино"),
    "tsoi": ("kino", "кино"),
    "viktor tsoy": ("kino", "кино"),
    "viktor tsoi": ("kino", "кино"),
}
ALIAS_CONFIDENCE, NORMALIZED_SHARE, LEAST_CONFIDENCE = 0.95, 0.8, 0.1


def alias_table(spark, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    return spark.createDataFrame(list({k: list(v) for k, v in aliases.items()}.items()), "alias string, canonical array<string>")


def first_by_fold(items: Column, text) -> Column:
    """Of an array, the first element of each case-folded text, blanks dropped, in order."""
    kept = F.filter(items, lambda x: x.isNotNull() & (text(x) != ""))
    keyed = F.transform(kept, lambda x: F.struct(casefold(text(x)).alias("key"), x.alias("item")))

    def first(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r["key"])
        return F.transform(F.filter(rows, lambda r, i: F.array_position(keys, r["key"]) == i + 1), lambda r: r["item"])

    # The keys are bound once, not written out at each use.
    return F.get(F.transform(F.array(keyed), first), F.lit(0))


def with_alias_variants(parsed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``alias_variants``: "canonical - title" per alias, then their Latin spellings."""
    key = collapse(casefold(F.coalesce(F.col("artist"), F.lit(""))))
    rows = settle(parsed, {"_key": key}).join(F.broadcast(aliases.withColumnRenamed("alias", "_key")), "_key", "left")
    known = F.col("canonical").isNotNull() & F.col("title").isNotNull()
    plain = F.transform("canonical", lambda a: collapse(F.concat(a, F.lit(" - "), F.col("title"))))
    both = F.concat(plain, F.transform(plain, to_latin))
    variants = F.when(known, first_by_fold(both, lambda x: x)).otherwise(F.array().cast("array<string>"))
    return settle(rows, {"alias_variants": variants}).drop("_key", "canonical")


def with_variants(parsed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``query_variants``: (text, source, confidence, explanation) in order of trial."""
    aliases = alias_table(parsed.sparkSession) if aliases is None else aliases
    rows = with_alias_variants(parsed, aliases)

    def variant(text: Column, source: Column | str, confidence: Column, why: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(collapse(text).alias("text"), lit(source).alias("source"), confidence.cast("double").alias("confidence"), lit(why).alias("explanation"))

    has_artist, has_title = truthy(F.col("artist")), truthy(F.col("title"))
    conf = F.col("confidence")
    fields = F.concat(F.col("artist"), F.lit(" - "), F.col("title"))
    rows = rows.withColumn("_c", round4(conf)).withColumn("_c_norm", round4(F.greatest(conf * NORMALIZED_SHARE, F.lit(LEAST_CONFIDENCE))))
    head = F.when(has_artist & has_title, variant(fields, "parsed_fields", F.col("_c"), "both parsed fields")).when(
        has_title, variant(F.col("title"), "parsed_title", F.col("_c"), "the parsed title alone")
    )
    alias = F.transform("alias_variants", lambda t: variant(t, "artist_alias", F.greatest(F.col("_c"), F.lit(ALIAS_CONFIDENCE)), "a known alias of the artist"))
    whole = F.when(truthy(F.col("normalized_input")), variant(F.col("normalized_input"), "normalized_input", F.col("_c_norm"), "the whole normalised line"))
    other = F.transform("transliteration_candidates", lambda c: variant(c["text"], F.concat(F.lit("transliteration:"), c["direction"]), c["confidence"], c["explanation"]))
    every = F.concat(F.array(head), alias, F.array(whole), other)
    return settle(rows, {"query_variants": first_by_fold(every, lambda v: v["text"])}).drop("_c", "_c_norm", "alias_variants")
