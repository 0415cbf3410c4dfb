"""Tables written between the stages of a plan, and joins bounded by counted sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when counts prove it within both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Folders written by ``materialize``, oldest first, until ``release`` removes them.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as the session names it.

    A session without ``spark.checkpoint.dir`` gets a temporary folder if it runs on one
    machine only (tests); on a cluster executors could not read each other's files there,
    so that is an error.
    """
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="linkengine-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recomputation),
    gives the optimizer a real size, and leaves the next join free to exchange, and
    therefore to split skewed partitions of, both of its sides.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written folders, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the folders written after ``since``, but for the last ``keep`` of them.

    Only the caller knows when results that read them are consumed, so nothing is
    removed unasked.
    """
    upto = len(_written) - keep
    gone, _written[since:upto] = _written[since:upto], []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        where = hadoop(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        items = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType))
        return F.coalesce(items, F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def fits_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a count of rows and bytes proves ``small`` (a written table) within the bounds."""
    if not rows:
        return False
    # The whole row goes through one column, so no name can clash.
    width = _width(F.struct(*(F.col(f"`{c}`") for c in small.columns)), small.schema)
    found = small.select(width.cast("long").alias("n")).agg(F.count("*"), F.sum("n")).first()
    return found[0] <= rows and (found[1] or 0) <= size


def lookup_join(
    big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "left", bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large side to a materialized lookup side.

    The lookup is broadcast if its counted rows and bytes are within bounds; otherwise the
    join stays a shuffle join of two plain exchanges, which AQE splits where skewed. Sizes of
    files say little: a written table of few distinct values is many times larger in memory.
    """
    small = F.broadcast(small) if fits_broadcast(small, bound) else small.hint("merge")
    return big.join(small, on, how)
