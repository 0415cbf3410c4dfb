"""Lists as JSON, CSV and M3U text, one row per list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import truthy

#: The columns of the CSV form and the media types.
CSV_COLUMNS = [
    "position", "raw_input", "parsed_artist", "parsed_title", "parser_confidence", "match_track_id",
    "match_external_url", "match_score", "match_algorithm", "source", "is_uncertain",
]
MEDIA_TYPES = {"json": "application/json", "csv": "text/csv", "m3u": "audio/x-mpegurl"}


def display_title(artist: Column, title: Column, raw: Column) -> Column:
    """``artist - title``, else the title, else the raw line; empty counts as missing."""
    return F.when(truthy(artist) & truthy(title), F.concat(artist, F.lit(" - "), title)).when(truthy(title), title).otherwise(raw)


def _number(x: Column) -> Column:
    """A double as its shortest text, without an exponent from 1e-4 on."""
    plain = F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0"))
    return F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e-3), plain).otherwise(x.cast("string"))


def _csv_field(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "boolean":
        text = F.initcap(c.cast("string"))
    elif kind == "double":
        text = _number(c)
    else:
        text = c.cast("string")
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(items: DataFrame) -> Column:
    kinds = dict(items.dtypes)
    return F.concat_ws(",", *(_csv_field(c, kinds[c]) for c in CSV_COLUMNS))


def m3u_lines(items: DataFrame) -> Column:
    title = display_title(F.col("parsed_artist"), F.col("parsed_title"), F.col("raw_input"))
    target = F.when(truthy(F.col("match_external_url")), F.col("match_external_url")).when(truthy(F.col("match_track_id")), F.col("match_track_id")).otherwise(title)
    return F.concat(F.lit("#EXTINF:-1,"), title, F.lit("\n"), target)


def export_lists(lists: DataFrame, items: DataFrame, fmt: str) -> DataFrame:
    """(playlist_id, filename, format, media_type, content, total_items) for every list."""
    if fmt not in MEDIA_TYPES:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(MEDIA_TYPES)}")
    if fmt == "json":
        columns = [c for c in CSV_COLUMNS if c != "position"] + [c for c in ("item_id", "metadata_json") if c in items.columns]
        line = F.struct(*columns)
    else:
        line = csv_line(items) if fmt == "csv" else m3u_lines(items)
    rows = items.select("playlist_id", F.struct("position", line.alias("line")).alias("row")).groupBy("playlist_id")
    rows = rows.agg(F.array_sort(F.collect_list("row")).alias("rows"), F.count("*").alias("total_items"))
    out = lists.join(rows, "playlist_id", "left").withColumn("total_items", F.coalesce("total_items", F.lit(0)))
    text = F.coalesce(F.transform("rows", lambda r: r["line"]), F.array())
    if fmt == "csv":
        content = F.concat(F.array_join(F.concat(F.array(F.lit(",".join(CSV_COLUMNS))), text), "\n"), F.lit("\n"))
    elif fmt == "m3u":
        content = F.concat(F.array_join(F.concat(F.array(F.lit("#EXTM3U")), text), "\n"), F.lit("\n"))
    else:
        flat = F.transform("rows", lambda r: F.struct(r["position"].alias("position"), *(r["line"][c].alias(c) for c in columns)))
        body = F.struct("playlist_id", "session_id", "name", "created_at", "total_items", F.coalesce(flat, F.array()).alias("items"))
        content = F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"})
    key = F.col("playlist_id").cast("string")
    name = F.concat(F.lit("playlist-"), key, F.lit(f".{fmt}"))
    return out.select("playlist_id", name.alias("filename"), F.lit(fmt).alias("format"), F.lit(MEDIA_TYPES[fmt]).alias("media_type"), content.alias("content"), "total_items")


def download_names(items: DataFrame) -> DataFrame:
    """(playlist_id, ordinal, item_id, filename) of the items that can be downloaded.

    The ordinal counts them per list in order of position, with two digits at least.
    """
    rows = items.filter(downloadable(F.col("match_external_url")))
    order = Window.partitionBy("playlist_id").orderBy("position", "item_id")
    artist, title, raw = (F.col(c) for c in ("parsed_artist", "parsed_title", "raw_input"))
    # A field counts as missing by its own text, before anything is stripped from it.
    only = F.when(truthy(title), safe_filename(title)).otherwise(safe_filename(raw))
    name = F.when(truthy(artist) & truthy(title), F.concat(safe_filename(artist), F.lit(" - "), safe_filename(title))).otherwise(only)
    rows = rows.withColumns({"ordinal": F.row_number().over(order), "_name": name})
    return rows.select("playlist_id", "ordinal", "item_id", F.format_string("%02d - %s", "ordinal", "_name").alias("filename"))


def downloadable(url: Column) -> Column:
    """Whether a url belongs to the video site downloads are made from."""
    return F.coalesce(url.contains("youtube.com") | url.contains("youtu.be"), F.lit(False))


def safe_filename(name: Column) -> Column:
    """Letters, digits and `` -_()`` of a name, outer white space stripped."""
    from ..functions.unicode import strip

    return strip(F.regexp_replace(name, r"[^\p{L}\p{N} \-_()]", ""))
