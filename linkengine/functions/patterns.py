"""Two-field patterns of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settle
from .text import clean_field, clean_title, looks_like_metadata
from .unicode import WS, truthy

SEPARATOR = rf"(?:[{WS}]+[-|][{WS}]+|:[{WS}]+)"
#: The first line of text up to a last bracket pair; ``.`` stops at a line feed only.
_IN_PARENTHESES = rf"(?d)^(.+?)[{WS}]*\(([^()]+)\)[{WS}]*$"
_IN_BRACKETS = rf"(?d)^(.+?)[{WS}]*\[([^\[\]]+)\][{WS}]*$"
#: Confidence of each pattern.
CONFIDENCE = {"artist_title": 0.9, "title_artist": 0.78, "title_artist_parenthesis": 0.82, "title_artist_brackets": 0.82, "unknown": 0.25}


def with_pattern(df: DataFrame, text: str = "normalized_input", order: str = "artist_title") -> DataFrame:
    """Add ``artist``, ``title``, ``confidence``, ``pattern`` and ``explanation``.

    A separator pattern is tried first, then a second field in parentheses or, where no
    parentheses match, in brackets; else the line is kept as a title.
    """
    if order not in ("artist_title", "title_artist"):
        raise ValueError("order must be artist_title or title_artist")
    s = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(s, SEPARATOR, 2)
    df = settle(df, {"_left": clean_field(F.get(parts, F.lit(0))), "_right": clean_field(F.get(parts, F.lit(1)))})
    first, second = ("_left", "_right") if order == "artist_title" else ("_right", "_left")
    # A title after a separator is cleaned twice, so two closing tags go.
    separated = {"_sep_artist": F.col(first), "_sep_title": clean_title(clean_title(F.col(second)))}
    has_sep = truthy(F.col("_sep_artist")) & truthy(F.col("_sep_title"))

    # The regexes are tried only where the closing mark is there at all.
    round_ = s.contains(")") & s.rlike(_IN_PARENTHESES)
    square = ~round_ & s.contains("]") & s.rlike(_IN_BRACKETS)

    def group(i: int) -> Column:
        return F.when(round_, F.regexp_extract(s, _IN_PARENTHESES, i)).when(square, F.regexp_extract(s, _IN_BRACKETS, i))

    df = settle(df, {**separated, "_bracket_title": clean_field(group(1)), "_bracket_artist": clean_field(group(2)), "_round": round_})
    bracket = truthy(F.col("_bracket_title")) & truthy(F.col("_bracket_artist")) & ~looks_like_metadata(F.col("_bracket_artist"))

    df = settle(df, {"_has_bracket": bracket})
    has_bracket = F.col("_has_bracket")
    pattern = (
        F.when(s == "", "unknown").when(has_sep, order).when(has_bracket & F.col("_round"), "title_artist_parenthesis")
        .when(has_bracket, "title_artist_brackets").otherwise("unknown")
    )
    artist = F.when(s == "", None).when(has_sep, F.col("_sep_artist")).when(has_bracket, F.col("_bracket_artist"))
    title = (
        F.when(s == "", None).when(has_sep, F.col("_sep_title")).when(has_bracket, clean_title(F.col("_bracket_title")))
        .otherwise(clean_title(s))
    )
    df = settle(df, {"pattern": pattern, "artist": artist, "title": title})
    confidence = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        confidence = F.when((F.col("pattern") == name) & (s != ""), F.lit(value)).otherwise(confidence)
    why = (
        F.when(s == "", "the line is empty after normalisation")
        .when(has_sep, f"two fields around a separator, read as {order.replace('_', ' then ')}")
        .when(has_bracket, "a title with a second field in brackets")
        .otherwise("no pattern; the line is kept as a title")
    )
    df = settle(df, {"confidence": confidence, "explanation": why})
    return df.drop("_left", "_right", "_sep_artist", "_sep_title", "_bracket_title", "_bracket_artist", "_round", "_has_bracket")
