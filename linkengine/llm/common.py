"""Helpers shared by the operators: table access, names, shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import fits_broadcast, lookup_join, mark, materialize, release, shared_dir

__all__ = ["fits_broadcast", "keyed", "lookup_join", "lower_az", "mark", "materialize", "numbered", "quoted", "read_table", "release", "remaining", "row_key", "shared_dir", "unpacked", "unused"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row: its id and a digest of its text.

    Rows that agree in both are the same document for every operator, so repeated
    rows need no generated id (which would not survive a recomputed partition).
    """
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")]


def keyed(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, _row): the row's identity and all its columns packed into one, so that
    no column name of the input can meet one of an operator."""
    return rows.select(*row_key(doc_id, text), F.struct(*quoted(rows.columns)).alias("_row"))


def quoted(names: list[str]) -> list[Column]:
    """The columns ``names``, which may hold dots and backquotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def numbered(names: list[str]) -> list[Column]:
    """The columns ``names`` under plain ones, since ``mapInArrow`` resolves its input by name."""
    return [c.alias(f"_{i}") for i, c in enumerate(quoted(names))]


def remaining(rows: DataFrame, added: list[str]) -> list[str]:
    """The columns that ``added`` ones do not replace; as in Spark, case makes no difference."""
    gone = {c.lower() for c in added}
    return [c for c in rows.columns if c.lower() not in gone]


def unused(name: str, rows: DataFrame) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unpacked(names: list[str]) -> list[Column]:
    """The columns ``names`` of a packed row."""
    return [F.col("_row")[c].alias(c) for c in names]
