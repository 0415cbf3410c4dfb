"""Sources of raw lines and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import strip

CATALOG_SCHEMA = "track_id string, artist string, title string, source string, external_url string"
LABELLED_LINE_SCHEMA = "raw_input string, expected_artist string, expected_title string, expected_pattern string, notes string"
LABELLED_QUERY_SCHEMA = "query string, expected_track_id string, notes string"


def from_list(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(line_id, raw_input) in the order given; at least one line."""
    if not lines:
        raise ValueError("at least one line is needed")
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_input string")


def split_text(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_id, raw_input): the trimmed, non-empty lines of multi-line texts."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_id", "raw_input"))
    return rows.withColumn("raw_input", strip(F.col("raw_input"))).filter("raw_input <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped. A line that is no JSON, or no JSON
    object, fails the read with the number of the first such line.

    An object that repeats a key counts as malformed.
    """
    read = spark.read.text(path).select("value", *(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")))
    lines = read.withColumn("id", F.monotonically_increasing_id())
    object_ = strip(F.col("value")).startswith("{")
    kind = F.when(F.try_parse_json("value").isNull(), "Invalid JSON").when(~object_, "Expected a JSON object")
    wrong = lines.filter(strip(F.col("value")) != "").withColumn("why", kind).filter("why IS NOT NULL")
    first = wrong.orderBy("file_path", "file_block_start", "id").select("file_path", "file_block_start", "id", "why").first()
    if first:
        # Ids rise within a file's split, so whole earlier splits are counted.
        before = (F.col("file_block_start") < first["file_block_start"]) | ((F.col("file_block_start") == first["file_block_start"]) & (F.col("id") <= first["id"]))
        number = lines.filter((F.col("file_path") == first["file_path"]) & before).count()
        raise ValueError(f"{first['why']} on line {number} in {first['file_path']}")
    rows = read.filter(strip(F.col("value")) != "").select(F.from_json("value", schema).alias("row"))
    return rows.select("row.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CATALOG_SCHEMA)


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, LABELLED_LINE_SCHEMA)


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, LABELLED_QUERY_SCHEMA)


def catalog_from(df: DataFrame, track_id, artist, title, order, url=None) -> DataFrame:
    """A catalog from any table; ``order`` is the candidates' own order."""
    url = F.lit(None).cast("string") if url is None else url
    return df.select(track_id.cast("string").alias("track_id"), artist.alias("artist"), title.alias("title"), url.alias("external_url"), order.alias("cand_ord"))


def demo_catalog(spark: SparkSession) -> DataFrame:
    """A catalog of four rows for trials."""
    rows = [
        ("demo-1", "Blue Harbor", "Night Train", None, 0),
        ("demo-2", "Ледокол", "Белый шум", None, 1),
        ("demo-3", "Ledokol", "Belyy Shum", None, 2),
        ("demo-4", None, "Blue Harbor - Night Train (Official Video)", None, 3),
    ]
    return spark.createDataFrame(rows, "track_id string, artist string, title string, external_url string, cand_ord int")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A relational table, read in parallel over ranges of ``column`` (a number, date or timestamp).

    The ranges are cut between the column's least and greatest value, which the database is asked for; rows where it is
    null come with the first. Filters and columns of the result are pushed to the database, and so is the range of each partition. An
    empty table, or one whose column holds one value, is read at once. ``table`` may be a parenthesised query with an alias.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    read = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    if column is None or partitions == 1:
        return read(dbtable=table)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)  # as the database spells names
    low, high = read(query=f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}").first()
    if low is None or low == high:
        return read(dbtable=table)
    return read(dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
