"""Script detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounding import with_round4
from .settle import settle


def with_language(df: DataFrame, text: str = "normalized_input", mixed_threshold: float = 0.2) -> DataFrame:
    """Add ``language`` (en, ru, mixed, unknown), ``language_confidence``, ``cyrillic_ratio``,
    ``latin_ratio`` and ``language_explanation``."""
    if not 0.0 <= mixed_threshold <= 0.5:
        raise ValueError("mixed_threshold must be between 0.0 and 0.5")
    s = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_cyr": F.regexp_count(s, F.lit("(?iu)[а-яё]")), "_lat": F.regexp_count(s, F.lit("(?iu)[a-z]"))})
    total = F.col("_cyr") + F.col("_lat")
    df = with_round4(df, "cyrillic_ratio", F.when(total > 0, F.col("_cyr") / total).otherwise(0.0))
    df = with_round4(df, "latin_ratio", F.when(total > 0, F.col("_lat") / total).otherwise(0.0))
    minority = F.least("_cyr", "_lat") / total
    mixed = (F.col("_cyr") > 0) & (F.col("_lat") > 0) & (minority >= mixed_threshold)
    label = F.when(total == 0, "unknown").when(mixed, "mixed").when(F.col("_cyr") >= F.col("_lat"), "ru").otherwise("en")
    df = df.withColumn("language", label)
    df = with_round4(df, "_mixed_confidence", F.when(mixed, minority + 0.5).otherwise(0.0))
    confidence = (
        F.when(F.col("language") == "unknown", 0.0)
        .when(F.col("language") == "mixed", F.col("_mixed_confidence"))
        .when(F.col("language") == "ru", F.col("cyrillic_ratio"))
        .otherwise(F.col("latin_ratio"))
    )
    why = F.when(F.col("language") == "unknown", "no letters of a known script").otherwise(
        F.format_string("%d Cyrillic and %d Latin letters", "_cyr", "_lat")
    )
    names = ("language", "cyrillic_ratio", "latin_ratio")
    df = settle(df, {**{c: F.col(c) for c in names}, "language_confidence": confidence, "language_explanation": why})
    return df.drop("_cyr", "_lat", "_mixed_confidence")
