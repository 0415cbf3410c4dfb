"""Lines to parsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import with_language
from ..functions.patterns import with_pattern
from ..functions.settle import settle
from ..functions.text import detector_normalize, with_normalized
from ..functions.translit import with_transliterations
from ..functions.unicode import strip


def parse(lines: DataFrame, order: str = "artist_title", mixed_threshold: float = 0.2) -> DataFrame:
    """Add the columns of a parsed row to (line_id, raw_input). Rows are stateless, so this
    also runs on a stream."""
    rows = with_language(with_normalized(lines), mixed_threshold=mixed_threshold)
    return with_pattern(with_transliterations(rows), order=order)


def detect(lines: DataFrame, order: str = "artist_title") -> DataFrame:
    """The pattern detector alone, on its own normalisation, which keeps case."""
    rows = settle(lines, {"normalized_input": detector_normalize(F.coalesce(F.col("raw_input"), F.lit("")))})
    return with_pattern(rows, order=order)


def parse_lines(lines: DataFrame, skip_blank: bool = True, order: str = "artist_title") -> DataFrame:
    """Parsed rows; ``skip_blank`` drops lines whose normalised text is empty."""
    rows = parse(lines, order)
    return rows.filter("normalized_input <> ''") if skip_blank else rows


def drop_blank_raw(lines: DataFrame) -> DataFrame:
    """Lines with more than white space in their raw text (an index alone survives)."""
    return lines.filter(strip(F.coalesce(F.col("raw_input"), F.lit(""))) != "")


def summary(parsed: DataFrame) -> DataFrame:
    """Rows by pattern and language."""
    return parsed.groupBy("pattern", "language").agg(F.count("*").alias("n_lines"), F.avg("confidence").alias("avg_confidence"))
