"""Catalog tables of lists, items and sessions: their versions, and their layout by list.

``migrate`` brings a database to a version by ordered steps. Every step may run again after a crash, since it looks at what is there
first, and is recorded when it is done. Columns are only ever added, at the end, so files written before stay readable and
show null in them; there is no way back.

Lists and items are bucketed by ``playlist_id`` into equally many buckets, so joining, counting and deleting by list
needs no exchange. A list's items lie in one bucket, sorted; more lists than buckets is what spreads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lists import ITEM_SCHEMA, LIST_SCHEMA, SESSION_SCHEMA

BUCKETS = 64
SESSIONS, LISTS, ITEMS, VERSIONS = "user_sessions", "playlists", "playlist_items", "schema_versions"


def _without(schema: str, *columns: str) -> str:
    return ", ".join(c for c in schema.split(", ") if c.split()[0] not in columns)


def _create(spark: SparkSession, table: str, schema: str, buckets: int | None = None) -> None:
    clustered = f" CLUSTERED BY (playlist_id) SORTED BY (playlist_id) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet{clustered}")


def _add_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> None:
    missing = [f"{c} {kind}" for c, kind in columns.items() if c not in spark.table(table).columns]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(missing)})")


def _first(spark: SparkSession, database: str, buckets: int) -> None:
    _create(spark, f"{database}.{LISTS}", LIST_SCHEMA, buckets)
    _create(spark, f"{database}.{ITEMS}", _without(ITEM_SCHEMA, "match_external_url"), buckets)


def _second(spark: SparkSession, database: str, buckets: int) -> None:
    _create(spark, f"{database}.{SESSIONS}", SESSION_SCHEMA)


def _third(spark: SparkSession, database: str, buckets: int) -> None:
    _add_columns(spark, f"{database}.{ITEMS}", {"match_external_url": "string"})


#: In order; a step's number is its place from 1. Never change one that has been released.
STEPS: list[tuple[str, Callable[[SparkSession, str, int], None]]] = [("lists and items", _first), ("sessions", _second), ("urls of matches", _third)]


def version(spark: SparkSession, database: str) -> int:
    """The last step recorded, 0 for a database without tables."""
    if not spark.catalog.tableExists(f"{database}.{VERSIONS}"):
        return 0
    return spark.table(f"{database}.{VERSIONS}").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def migrate(spark: SparkSession, database: str, to: int | None = None, buckets: int = BUCKETS) -> int:
    """Run the steps that are missing up to ``to`` (the last by default); the version reached."""
    to = len(STEPS) if to is None else to
    at = version(spark, database)
    if not 0 <= to <= len(STEPS) or at > len(STEPS):
        raise ValueError(f"this library knows versions 0 to {len(STEPS)}, not {to if at <= len(STEPS) else at}")
    if to < at:
        raise ValueError(f"the database is at version {at}; there is no way back to {to}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    _create(spark, f"{database}.{VERSIONS}", "version int, step string, applied_at timestamp")
    for n in range(at + 1, to + 1):
        name, step = STEPS[n - 1]
        step(spark, database, buckets)
        done = spark.range(1).select(F.lit(n).alias("version"), F.lit(name).alias("step"), F.current_timestamp().alias("applied_at"))
        done.write.mode("append").insertInto(f"{database}.{VERSIONS}")
    return to


def append(rows: DataFrame, database: str, table: str) -> None:
    """Append rows by column name; columns that the table has and the rows lack are null, others are an error."""
    target = rows.sparkSession.table(f"{database}.{table}")
    unknown = set(rows.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"{table} has no columns {', '.join(sorted(unknown))}")
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
    rows.select(*columns).write.mode("append").insertInto(f"{database}.{table}")


def save_by_list(rows: DataFrame, table: str, buckets: int = BUCKETS, order: tuple[str, ...] = ("playlist_id",), path: str | None = None) -> DataFrame:
    """Write rows as a table bucketed by ``playlist_id``, a file per bucket, and read it. With ``path`` the table's files
    lie there and not in the warehouse."""
    write = rows.repartition(buckets, "playlist_id").write.format("parquet").bucketBy(buckets, "playlist_id").sortBy(*order)
    (write.option("path", path) if path else write).saveAsTable(table)
    return rows.sparkSession.table(table)
