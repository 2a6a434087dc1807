"""Size checks that decide between a broadcast and a shuffle, and lineage cuts for tables read several times."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table that is copied to every executor, in bytes.
BROADCAST_BYTES = 128 * 1024 * 1024
# Largest narrow table that is copied to every executor, in bytes of its values.
NARROW_BYTES = 32 * 1024 * 1024

# Stored tables by session, for ``release``, and the folders made for sessions that name none.
_stored: dict[int, list[str]] = {}
_folders: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder, one per session, is used only where that setting is absent, as in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if id(spark.sparkContext) not in _folders:
        _folders[id(spark.sparkContext)] = tempfile.mkdtemp(prefix="wordloom-")
    return _folders[id(spark.sparkContext)]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors can reach, for what is stored and read back; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored.setdefault(id(spark.sparkContext), []).append(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back, so that later passes do not compute it again.

    ``release`` removes the stored copies once no result that reads them is needed.
    """
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every path that ``settled`` and ``scratch`` have given out in this session so far; returns how many.

    For use between jobs: a DataFrame that still reads such a table fails afterwards.
    """
    paths = _stored.pop(id(spark.sparkContext), [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one path that ``scratch`` has given out, ahead of ``release``, once nothing reads it any more."""
    _stored[id(spark.sparkContext)].remove(path)
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value: lengths of strings, 8 for a number, with what lies inside arrays, maps and structs."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        own = reduce(lambda a, b: a + b, [_bytes_of(value[f.name], f.dataType) for f in kind], F.lit(0))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            zero = F.lit(0).cast("long")
            own = F.aggregate(value, zero, lambda held, x: held + _bytes_of(x, kind.elementType).cast("long"))
        else:
            own = F.size(value) * 8
    elif isinstance(kind, T.MapType):
        own = _bytes_of(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(value), T.ArrayType(kind.valueType))
    else:
        own = F.lit(8)
    return F.coalesce(own, F.lit(0)) + 8


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of a table, those inside nested columns included."""
    each = [_bytes_of(F.col(f.name), f.dataType).cast("long") for f in df.schema]
    total = reduce(lambda a, b: a + b, each, F.lit(0).cast("long"))
    return df.agg(F.sum(total)).head()[0] or 0


def gathered(df: DataFrame, limit_bytes: int = NARROW_BYTES) -> tuple[DataFrame, pa.Table | None]:
    """The table computed once and stored, with its rows when their values take at most ``limit_bytes``.

    A table within the limit comes back as a broadcast copy. A larger one carries no hint, so Spark shuffles it and
    splits skewed keys at run time; its rows are then None and nothing of it has been fetched.
    """
    kept = settled(df)
    if value_bytes(kept) > limit_bytes:
        return kept, None
    rows = kept.toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def small_or_settled(df: DataFrame, limit_bytes: int = NARROW_BYTES) -> DataFrame:
    """As ``gathered``, for callers that need the table alone."""
    kept = settled(df)
    return F.broadcast(kept) if value_bytes(kept) <= limit_bytes else kept


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the key columns, a missing key matching a missing key as in a grouping."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
