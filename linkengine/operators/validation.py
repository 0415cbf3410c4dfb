"""Limits on rows that are saved, and counts taken in the same pass.

``checked`` keeps the rows that respect all limits and counts the others by rule while they pass, by ``observe``: the counts are there
when whatever consumes the rows has run, without a job of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.settle import settle

#: Greatest lengths of texts, and which must not be empty.
LENGTHS = {"name": 255, "display_name": 255, "session_id": 128, "parsed_artist": 255, "parsed_title": 255, "match_external_url": 1024, "match_algorithm": 128, "source": 128}
NOT_EMPTY = ["session_id", "raw_input", "match_algorithm", "source"]
UNIT_RANGE = ["parser_confidence", "match_score"]
REQUIRED = ["playlist_id", "session_id", "item_id", "position", "raw_input"]


def rules(columns: list[str]) -> dict[str, Column]:
    """What is wrong with a row, by rule, for those of its columns that have limits. Null is only wrong where required."""
    out: dict[str, Column] = {}
    for c in columns:
        value = F.col(f"`{c}`")
        if c in REQUIRED:
            out[f"{c}_missing"] = value.isNull()
        if c in LENGTHS:
            out[f"{c}_too_long"] = F.char_length(value) > LENGTHS[c]
        if c in NOT_EMPTY:
            out[f"{c}_empty"] = value == ""
        if c in UNIT_RANGE:
            out[f"{c}_out_of_range"] = ~value.between(0.0, 1.0) | F.isnan(value)
        if c == "position":
            out["position_negative"] = value < 0
    return {name: F.coalesce(wrong, F.lit(False)) for name, wrong in out.items()}


def checked(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The valid rows. ``seen`` gets ``total``, ``rejected`` and how many rows break each rule."""
    wrong = rules(rows.columns)
    if not wrong:
        return rows
    kept = rows.columns
    # Settled, so that the optimizer sees one short predicate and not every rule.
    rows = settle(rows, {"_broken": F.array_compact(F.array(*(F.when(rule, name) for name, rule in wrong.items())))})
    if seen is not None:
        each = [F.count_if(F.array_contains("_broken", name)).alias(name) for name in wrong]
        rows = rows.observe(seen, F.count("*").alias("total"), F.count_if(F.size("_broken") > 0).alias("rejected"), *each)
    return rows.filter(F.size("_broken") == 0).select(*(F.col(f"`{c}`") for c in kept))


def counted(items: DataFrame, seen: Observation) -> DataFrame:
    """Items as they are, with ``total`` and ``uncertain_count`` counted as they pass."""
    return items.observe(seen, F.count("*").alias("total"), F.coalesce(F.count_if("is_uncertain"), F.lit(0)).alias("uncertain_count"))
