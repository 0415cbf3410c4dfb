"""Persisted lists: building, reading and changing them.

Tables are immutable; a change is (table, change set) -> new table, written elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSION_SCHEMA = "id string, display_name string, created_at timestamp, last_seen_at timestamp"
LIST_SCHEMA = "playlist_id string, session_id string, name string, created_at timestamp"
ITEM_SCHEMA = (
    "item_id string, playlist_id string, position int, raw_input string, parsed_artist string, parsed_title string, "
    "parser_confidence double, match_track_id string, match_external_url string, match_score double, "
    "match_algorithm string, source string, is_uncertain boolean, metadata_json string"
)
DEFAULT_NAME = "Untitled Playlist"
#: The parsed fields that the metadata of an item keep.
PARSED_FIELDS = [
    "raw_input", "normalized_input", "artist", "title", "confidence", "pattern", "explanation", "language", "language_confidence",
    "language_explanation", "normalization_steps", "transliteration_candidates", "transliteration_explanation",
]
#: What a manual review takes where it says nothing.
REVIEW_ALGORITHM, REVIEW_SOURCE, REVIEW_SCORE = "manual", "manual", 0.99


class NotFound(LookupError):
    """A looked-up row does not exist."""

    code, status = "not_found", 404


def list_name(name):
    """The trimmed name, else the default."""
    from ..functions.unicode import strip

    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(DEFAULT_NAME))


def new_lists(requests: DataFrame) -> DataFrame:
    """List rows of (playlist_id, session_id, name): names are trimmed, and one that is blank or null is the default.
    ``created_at`` is kept if there is one, else it is now."""
    at = F.col("created_at") if "created_at" in requests.columns else F.current_timestamp()
    return requests.select(F.col("playlist_id").cast("string"), F.col("session_id").cast("string"), list_name(F.col("name")).alias("name"), at.cast("timestamp").alias("created_at"))


def build_items(items: DataFrame, playlist_id: str = "playlist_id") -> DataFrame:
    """Item rows of matched lines (with ``playlist_id`` and ``line_id``), position from 0.

    The metadata hold every parsed field, the query variants, the reports of the sources
    (none unless the lines carry ``source_reports``) and the explanation of the match.
    """
    order = Window.partitionBy(playlist_id).orderBy("line_id")
    reports = F.col("source_reports") if "source_reports" in items.columns else F.array()
    members = F.struct(F.struct(*PARSED_FIELDS).alias("parsed_track"), "query_variants", reports.alias("source_reports"), F.col("match_explanation").alias("explanation"))
    metadata = F.to_json(members, {"ignoreNullFields": "false"})
    return items.select(
        F.concat_ws("-", F.col(playlist_id), F.col("line_id").cast("string")).alias("item_id"),
        F.col(playlist_id).cast("string").alias("playlist_id"),
        (F.row_number().over(order) - 1).alias("position"),
        "raw_input",
        F.col("artist").alias("parsed_artist"),
        F.col("title").alias("parsed_title"),
        F.col("confidence").alias("parser_confidence"),
        F.col("best.track_id").alias("match_track_id"),
        F.col("best.external_url").alias("match_external_url"),
        F.col("best.score").alias("match_score"),
        F.col("best.algorithm").alias("match_algorithm"),
        F.col("best.source").alias("source"),
        "is_uncertain",
        metadata.alias("metadata_json"),
    )


def lists_of_session(lists: DataFrame, session_id) -> DataFrame:
    """A session's lists, newest first."""
    return lists.filter(F.col("session_id") == session_id).orderBy(F.col("created_at").desc(), "playlist_id")


def found_or_raise(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise NotFound(what)
    return rows


def get_list(lists: DataFrame, playlist_id) -> DataFrame:
    return found_or_raise(lists.filter(F.col("playlist_id") == playlist_id), f"list {playlist_id}")


def get_item(items: DataFrame, item_id, playlist_id) -> DataFrame:
    """An item by its own id and that of its list."""
    found = items.filter((F.col("item_id") == item_id) & (F.col("playlist_id") == playlist_id))
    return found_or_raise(found, f"item {item_id} of list {playlist_id}")


def lookup_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item_id, playlist_id) asked for, ``found`` and the item's columns."""
    rows = items.withColumn("found", F.lit(True))
    asked = wanted.select("item_id", "playlist_id").distinct()
    return asked.join(rows, ["item_id", "playlist_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def summaries(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Lists with their number of items and of uncertain ones."""
    counts = items.groupBy("playlist_id").agg(F.count("*").alias("total_items"), F.count_if("is_uncertain").alias("uncertain_count"))
    rows = lists.join(counts, "playlist_id", "left")
    return rows.fillna(0, ["total_items", "uncertain_count"])


def with_items(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Lists with their items as an array in order of position."""
    columns = [c for c in items.columns if c not in ("playlist_id", "position")]
    rows = items.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"))
    return lists.join(rows, "playlist_id", "left")


def last_changes(changes: DataFrame, keys: list[str], fields: list[str], at: str = "changed_at") -> DataFrame:
    """One row per key: the one with the greatest ``at``, if there is such a column; among equals the greatest by ``fields``.
    Rows without a whole key are no changes."""
    order = [F.col(at)] if at in changes.columns else []
    rows = changes.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *fields)).alias("_last"))
    return rows.select(*keys, *(F.col("_last")[c].alias(c) for c in fields))


def rename_lists(lists: DataFrame, names: DataFrame) -> DataFrame:
    """Apply (playlist_id, name); a null name is a name. Of several names of a list the last counts (``last_changes``)."""
    changes = last_changes(names, ["playlist_id"], ["name"]).select("playlist_id", F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    name = F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("name"))
    return lists.join(changes, "playlist_id", "left").withColumn("name", name).select(*lists.columns)


def delete_lists(lists: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete lists with all their items."""
    keys = gone.select("playlist_id").distinct()
    return lists.join(keys, "playlist_id", "left_anti"), items.join(keys, "playlist_id", "left_anti")


def delete_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Delete items by (item_id, playlist_id); positions keep their gaps."""
    return items.join(gone.select("item_id", "playlist_id").distinct(), ["item_id", "playlist_id"], "left_anti")


def apply_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply manual reviews (item_id, playlist_id, match_track_id, match_external_url,
    match_score, match_algorithm, source, is_uncertain).

    What a review leaves null takes the default; an empty track id falls back to the
    current one, then to ``manual:<item_id>``. The metadata gains ``manual_review`` with all its members, null ones too;
    metadata that are no JSON object are kept as its member ``replaced_metadata``. Of several reviews of an item the last counts (``last_changes``).
    """
    fields = ["match_track_id", "match_external_url", "match_score", "match_algorithm", "source", "is_uncertain"]
    changes = last_changes(reviews, ["item_id", "playlist_id"], fields)
    changes = changes.select("item_id", "playlist_id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    track = F.coalesce(F.nullif(F.trim("_match_track_id"), F.lit("")), F.col("match_track_id"), F.concat(F.lit("manual:"), F.col("item_id")))
    new = {
        "match_track_id": track,
        "match_external_url": F.col("_match_external_url"),
        "match_score": F.coalesce("_match_score", F.lit(REVIEW_SCORE)),
        "match_algorithm": F.coalesce("_match_algorithm", F.lit(REVIEW_ALGORITHM)),
        "source": F.coalesce("_source", F.lit(REVIEW_SOURCE)),
        "is_uncertain": F.coalesce("_is_uncertain", F.lit(False)),
    }
    rows = items.join(changes, ["item_id", "playlist_id"], "left")
    rows = rows.withColumns({c: F.when(F.col("_hit"), value).otherwise(F.col(c)) for c, value in new.items()})
    if "metadata_json" in items.columns:
        # Members keep their types as variants; only the top level is taken apart.
        members = "map<string,variant>"
        valid = F.col("metadata_json").isNull() | F.try_parse_json("metadata_json").isNotNull() & F.col("metadata_json").rlike(r"^\s*\{")
        old = F.coalesce(F.when(valid, F.from_json("metadata_json", members)), F.from_json(F.lit("{}"), members))
        told = F.struct(*(F.col(c) for c in fields), F.when(~valid, F.col("metadata_json")).alias("replaced_metadata"))
        shown = F.when(valid, F.to_json(told.dropFields("replaced_metadata"), {"ignoreNullFields": "false"})).otherwise(F.to_json(told, {"ignoreNullFields": "false"}))
        review = F.create_map(F.lit("manual_review"), F.parse_json(shown))
        merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != "manual_review"), review))
        rows = rows.withColumn("metadata_json", F.when(F.col("_hit"), merged).otherwise(F.col("metadata_json")))
    return rows.select(*items.columns)


def sessions_from_events(events: DataFrame, session: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions as the state of their touches: created at the first, last seen at the last."""
    rows = events.filter(F.col(session).isNotNull()).groupBy(F.col(session).cast("string").alias("session_id"))
    return rows.agg(F.min(at).alias("created_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("n_touches"))


def touch(sessions: DataFrame, touches: DataFrame) -> DataFrame:
    """Set ``last_seen_at`` of known sessions from (id, ts)."""
    last = touches.groupBy("id").agg(F.max("ts").alias("_ts"))
    rows = sessions.join(last, "id", "left").withColumn("last_seen_at", F.coalesce("_ts", "last_seen_at"))
    return rows.select(*sessions.columns)
