"""Nearest rows for one or many query vectors.

Many queries are answered in one pass over the word table. Which side is copied to the executors depends on its
checked size; when neither side is small, rows are dealt to cells and only the cells that a bound leaves open are
joined (``pruned``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.bounds import settled
from wordloom.operators.kernels import LOWER_IS_BETTER, Best, matrix, scan_block
from wordloom.operators.pruned import ANSWERS, best_answers, read_blocks, search
from wordloom.operators.topn import top_n_per_group
from wordloom.sources.binary import located

# Largest side of a batch search that is copied to the tasks, which read it from where it is stored.
QUERY_BYTES = 32 * 1024 * 1024


def _schema(qid: T.DataType) -> T.StructType:
    types = [qid, T.StringType(), T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType()]
    return T.StructType([T.StructField(name, kind) for name, kind in zip(ANSWERS, types)])


def best_first(metric: str, score: str = "score") -> Column:
    """Sort order that puts the best score first."""
    if metric not in LOWER_IS_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    return F.col(score).asc() if LOWER_IS_BETTER[metric] else F.col(score).desc()


def find_nearest(df: DataFrame, query: Sequence[float], n: int, metric: str = "cosine") -> DataFrame:
    """The ``n`` best rows for one vector: ``index, word, score``, best first, lowest index first among equals."""
    order = best_first(metric)
    if n < 1:
        raise ValueError("n must be at least 1")
    asked = pa.table({"qid": pa.array([0], pa.int64()), "vector": pa.array([[float(x) for x in query]], pa.list_(pa.float64()))})
    scan = _scan_with_queries(_broadcast_rows(df, asked), n, [metric])
    candidates = df.select("index", "word", "vector").mapInArrow(scan, _schema(T.LongType()))
    return candidates.select("index", "word", "score").orderBy(order, "index").limit(n)


def find_nearest_by(df: DataFrame, score: Column, n: int, lower_is_better: bool) -> DataFrame:
    """The ``n`` best rows under any score of the columns: ``index, word, vector, score``, lowest index first among equals.

    Each task keeps its ``n`` best. Rows whose score is NULL or NaN are not ranked.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    scored = df.select("index", "word", "vector", score.cast("double").alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.asc("score") if lower_is_better else F.desc("score"), "index").limit(n)


def find_nearest_multi(
    df: DataFrame,
    queries: DataFrame,
    n: int = 1,
    metric: str | Sequence[str] = "cosine",
    broadcast_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``n`` best rows for every query vector, as ``qid, metric, rank, index, word, score``.

    ``queries`` holds ``qid, vector`` with unique ``qid``. Several metrics may be asked for at once; they share the
    scan and the matrix product. Ties go to the lowest index. Zero vectors have no cosine and are left out.
    """
    metrics = [metric] if isinstance(metric, str) else list(metric)
    for m in metrics:
        best_first(m)
    if n < 1:
        raise ValueError("n must be at least 1")
    table = df.select("index", "word", "vector")
    queries = queries.select("qid", "vector")
    schema = _schema(queries.schema["qid"].dataType)
    dimensions = vector_size(table)
    queries = settled(queries)
    if fits(queries, _room(broadcast_bytes, n, dimensions, len(metrics)), dimensions):
        candidates = table.mapInArrow(_scan_with_queries(_stored_rows(queries), n, metrics), schema)
        return _ranked(candidates, n)
    if fits(table, broadcast_bytes, dimensions):
        # Every query meets the whole table in one task: nothing is left to merge.
        return queries.mapInArrow(_scan_with_table(_stored_rows(settled(table)), n, metrics), schema)
    return _ranked(search(table, queries, n, metrics, schema, broadcast_bytes).answers, n)


def _room(limit_bytes: int, n: int, dimensions: int, metrics: int) -> int:
    """What the vectors of queries may take so that they and their ``n`` places per metric stay within the limit."""
    vector, places = 8 * max(1, dimensions) + 16, 24 * n * metrics
    return limit_bytes * vector // (vector + places)


def vector_size(df: DataFrame, column: str = "vector") -> int:
    """Size of the first vector, 0 for an empty table."""
    head = df.select(F.size(column).alias("d")).head()
    return head["d"] if head is not None else 0


def fits(df: DataFrame, limit_bytes: int, dimensions: int) -> bool:
    """Whether the rows of a table take at most ``limit_bytes``. Rows and bytes of words are counted, no vector is read."""
    named = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    words = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in named), F.lit(0))
    held = df.agg(F.count(F.lit(1)).alias("n"), F.sum(words.cast("long")).alias("bytes")).head()
    return held["n"] * (8 * max(1, dimensions) + 16) + (held["bytes"] or 0) <= limit_bytes


def collected_within(df: DataFrame, limit_bytes: int, dimensions: int) -> pa.Table | None:
    """The rows of a stored table as Arrow data when they fit in ``limit_bytes``, else None."""
    return df.toArrow() if fits(df, limit_bytes, dimensions) else None


def _broadcast_rows(df: DataFrame, rows: pa.Table) -> Callable[[], pa.Table]:
    shared = df.sparkSession.sparkContext.broadcast(rows)
    return lambda: shared.value


def _stored_rows(stored: DataFrame) -> Callable[[], pa.Table]:
    """For tasks: all rows of a stored table, read from its files, so that none of them passes through the driver.

    Files that Arrow cannot reach are fetched and broadcast.
    """
    files, schema = sorted(stored.inputFiles()), to_arrow_schema(stored.schema)
    try:
        for file in files[:1]:
            located(file)
    except (pa.ArrowException, OSError):
        return _broadcast_rows(stored, stored.toArrow())

    def read() -> pa.Table:
        parts = [schema.empty_table()]
        for file in files:
            system, inner = located(file)
            found = pq.ParquetFile(inner, filesystem=system, coerce_int96_timestamp_unit="us").read()
            parts.append(found.select(schema.names).cast(schema))
        return pa.concat_tables(parts)

    return read


def _ranked(candidates: DataFrame, n: int) -> DataFrame:
    """The best ``n`` per query out of the best ``n`` of each task."""
    lower = F.col("metric").isin([m for m, low in LOWER_IS_BETTER.items() if low])
    key = F.when(lower, F.col("score")).otherwise(-F.col("score"))
    ranked = top_n_per_group(candidates.drop("rank"), ["qid", "metric"], [key, F.col("index")], n)
    return ranked.select(*ANSWERS)


def _scan_with_queries(rows: Callable[[], pa.Table], n: int, metrics: list[str]):
    def scan(batches):
        queries = rows()
        if not queries.num_rows:
            return
        vectors = matrix(queries.column("vector"))
        bests = [Best(vectors, n, m) for m in metrics]
        asked = bests[0].directions()
        for block in read_blocks(batches, vectors.shape[1]):
            scan_block(bests, block, asked)
        yield from best_answers(bests, queries.column("qid").combine_chunks())

    return scan


def _scan_with_table(rows: Callable[[], pa.Table], n: int, metrics: list[str]):
    def scan(batches):
        blocks = list(read_blocks(rows().to_batches(), None))
        for batch in batches:
            if blocks and batch.num_rows:
                vectors = matrix(batch.column("vector"), blocks[0].vectors.shape[1])
                bests = [Best(vectors, n, m) for m in metrics]
                asked = bests[0].directions()
                for block in blocks:
                    scan_block(bests, block, asked)
                yield from best_answers(bests, batch.column("qid"))

    return scan
