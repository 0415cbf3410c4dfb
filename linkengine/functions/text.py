"""Line normalisation, field cleaning and match normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settle import settle
from .unicode import WORD, WS, casefold, collapse, strip

#: Dashes that become a hyphen-minus.
DASHES = "—–−"
#: Fixed pattern: a list index or bullet at the start of a line.
INDEX_PREFIX = rf"^[{WS}]*(?:\p{{Nd}}{{1,4}}[{WS}]*[).\]:-][{WS}]*|[#*][{WS}]+|[•-][{WS}]+)"
#: Fixed pattern: one trailing bracketed tag of a title.
TITLE_TAG = (
    rf"(?iu)[{WS}]*[(\[][{WS}]*(?:official[{WS}]+(?:video|audio)|lyrics?|lyric[{WS}]+video|remaster(?:ed)?|"
    rf"live|music[{WS}]+video|клип|текст)[{WS}]*[)\]][{WS}]*$"
)
#: Beginnings of a bracketed text that is not a second field.
METADATA_STARTS = ("feat", "ft.", "ft ", "prod.", "official", "lyrics", "live")
#: Noise words inside brackets, and noise phrases standing alone, longest first.
BRACKET_NOISE = "official|video|lyrics?|audio|remaster(?:ed)?|visualizer|hd|4k"
NOISE_PHRASES = (
    "official music video",
    "official video",
    "official audio",
    "lyric video",
    "lyrics?",
    "music video",
    "visualizer",
    "remaster(?:ed)?",
    "hd",
    "4k",
)


def unify_dashes(s: Column) -> Column:
    return F.translate(s, DASHES, "-" * len(DASHES))


#: The steps of normalisation, in order: (name in the log, expression). The names,
#: the control characters and the characters that are kept are part of the contract.
STEPS = [
    ("trimmed_outer_whitespace", strip),
    ("removed_control_characters", lambda s: F.regexp_replace(s, r"[\x00-\x1f\x7f]", " ")),
    ("normalized_dash_characters", unify_dashes),
    ("removed_list_index_prefix", lambda s: F.regexp_replace(s, INDEX_PREFIX, "")),
    ("lowercased_text", F.lower),
    ("removed_special_characters", lambda s: F.regexp_replace(s, rf"[^{WORD}{WS}\-:|()\[\]&'.,+/]", " ")),
    ("collapsed_whitespace", collapse),
]


def with_normalized(df: DataFrame, raw: str = "raw_input") -> DataFrame:
    """Add ``normalized_input`` and ``normalization_steps``, the steps that changed the text."""
    stages = [f"_n{i}" for i in range(len(STEPS) + 1)]
    df = df.withColumn(stages[0], F.coalesce(F.col(raw), F.lit("")))
    for before, after, (_, step) in zip(stages, stages[1:], STEPS):
        df = df.withColumn(after, step(F.col(before)))
    log = F.array(*(F.when(F.col(a) != F.col(b), F.lit(name)) for a, b, (name, _) in zip(stages, stages[1:], STEPS)))
    return settle(df, {"normalized_input": F.col(stages[-1]), "normalization_steps": F.array_compact(log)}).drop(*stages)


def normalize(s: Column) -> Column:
    """The normalised text alone, as one expression."""
    for _, step in STEPS:
        s = step(s)
    return s


def detector_normalize(s: Column) -> Column:
    """The pattern detector's own normalisation, which keeps case."""
    s = F.regexp_replace(strip(unify_dashes(s)), INDEX_PREFIX, "")
    return collapse(F.btrim(s, F.lit(" \t\"'")))


def clean_field(s: Column) -> Column:
    return collapse(F.btrim(s, F.lit(" \t\"'")))


def clean_title(s: Column) -> Column:
    # A tag ends in a bracket; the regex is tried only where there is one.
    bracketed = s.contains(")") | s.contains("]")
    return clean_field(F.when(bracketed, F.regexp_replace(s, TITLE_TAG, "")).otherwise(s))


def looks_like_metadata(s: Column) -> Column:
    lowered = strip(F.lower(s))
    out = F.lit(False)
    for start in METADATA_STARTS:
        out = out | lowered.startswith(start)
    return out


def match_normalize(s: Column) -> Column:
    """Text as the scorers compare it."""
    phrases = "|".join(p.replace(" ", f"[{WS}]+") for p in NOISE_PHRASES)
    s = strip(casefold(s))
    s = F.regexp_replace(s, r"[_|/]+", " ")
    s = F.regexp_replace(s, rf"(?iu)\([^)]*(?:{BRACKET_NOISE})[^)]*\)|\[[^\]]*(?:{BRACKET_NOISE})[^\]]*\]", " ")
    s = F.regexp_replace(s, rf"(?iuU)\b(?:{phrases})\b", " ")
    return collapse(s)


def display_text(artist: Column, title: Column) -> Column:
    """``artist - title``, or the title where the artist is null or blank."""
    return F.when(strip(F.coalesce(artist, F.lit(""))) == "", title).otherwise(F.concat(artist, F.lit(" - "), title))


def same_label(a: Column, b: Column) -> Column:
    """Null-safe equality after case folding and white-space collapsing."""
    return collapse(casefold(a)).eqNullSafe(collapse(casefold(b)))
