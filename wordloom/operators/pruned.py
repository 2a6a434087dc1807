"""Batch search between two tables of which neither is small: cells of near rows, joined only where a bound allows an answer.

Rows are dealt to cells around pivots, rows that cannot be ranked left out. A cell is known by its pivot, the least and the greatest distance of its rows to
it, and their number. Every query is first joined with the nearest cells that hold enough rows; the worst of its places then
rules out, by the triangle inequality, what it can of the other cells, and only the rest is joined in a second round. There rows
and queries meet as tiles: runs of cells with chunks of queries. A vector is moved once for each tile of its row or column, of
which there are ``SIDE`` however many cells are left, until a tile would be larger than a task should hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.bounds import settled
from wordloom.operators.kernels import DISTANCES, Best, Block, Words, finite_rows, lengths, matrix, nearest_centre, scan_block
from wordloom.operators.topn import top_n_per_group

# Cells per block of ``block_bytes``: more cells make tighter bounds, and queries move once per cell left.
CELLS_PER_BLOCK = 8
MOST_CELLS = 4096
# Rows looked at for every pivot, and steps that move the pivots amid them. They set the speed, never the answer.
SAMPLE_PER_CELL = 16
PIVOT_STEPS = 4
# What one task is given of the rows, and of the queries, in the first round and at most in the second.
ROUND_BYTES = 16 * 1024 * 1024
TILE_BYTES = 64 * 1024 * 1024
# Tiles along each side, of sides that are large enough, and the partitions that tiles are dealt to, for each tile.
SIDE = 8
LEAST_TILE_BYTES = 256 * 1024
PARTITIONS_PER_TILE = 2
# Partitions of the first round, unless each had more than four of its tasks' shares.
ROUND_PARTITIONS = 96
# Rows that a task scores together, in bytes of their vectors.
POOLED_BYTES = 16 * 1024 * 1024
# Numbers that one routing step emits or compares at once.
ROUTED_CELLS = 2_000_000
# Inflation of every bound beyond the rounding of the sums behind it.
SLACK = 1e-9

Batches = Iterator[pa.RecordBatch]
ANSWERS = ["qid", "metric", "rank", "index", "word", "score"]


@dataclass
class Cells:
    """Pivots with, per cell, the number of rows and their distances to the pivot as they are and at unit length."""

    pivots: np.ndarray
    held: np.ndarray
    least: np.ndarray
    most: np.ndarray
    unit_most: np.ndarray

    def __post_init__(self):
        norms = lengths(self.pivots)
        self.norms = norms
        self.unit = self.pivots / np.where(norms > 0, norms, 1.0)[:, None]

    def apart(self, vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds below and above the distances between vectors and pivots, whatever the rounding of the product."""
        own, other = lengths(vectors)[:, None], lengths(pivots)[None, :]
        square = own**2 + other**2 - 2.0 * (vectors @ pivots.T)
        margin = 16.0 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps * (own + other) ** 2
        return np.sqrt(np.maximum(square - margin, 0.0)), np.sqrt(np.maximum(square + margin, 0.0))

    def home(self, vectors: np.ndarray, n: int, unit: bool) -> list[np.ndarray]:
        """The nearest cells of each query that together hold ``n`` rows, or all that hold any."""
        used = np.flatnonzero(self.held)
        pivots = (self.unit if unit else self.pivots)[used]
        order = np.argsort(np.nan_to_num(self.apart(vectors, pivots)[1], nan=np.inf), axis=1, kind="stable")
        enough = np.cumsum(self.held[used][order], axis=1)
        counts = np.minimum((enough < n).sum(axis=1) + 1, len(used))
        return [used[row[:count]] for row, count in zip(order, counts)]

    def out_of_reach(self, vectors: np.ndarray, metric: str, worst: np.ndarray) -> np.ndarray:
        """Which cells surely hold no row as good as the worst place of each query. Unknown bounds rule nothing out."""
        if metric in DISTANCES:
            low, high = self.apart(vectors, self.pivots)
            limit = np.sqrt(worst) if metric == "squared_euclidean" else worst
            bound = np.maximum(low - self.most * (1 + SLACK), self.least * (1 - SLACK) - high)
            return bound > (limit * (1 + SLACK))[:, None]
        norms = lengths(vectors)
        unit = vectors / np.where(norms > 0, norms, np.nan)[:, None]
        if metric == "cosine":
            # At unit length, cosine and distance say the same: cos = 1 - d^2 / 2.
            low, _ = self.apart(unit, self.unit)
            best = 1.0 - np.maximum(low - self.unit_most * (1 + SLACK), 0.0) ** 2 / 2
            # A query without length has no angle to any row.
            return (best < (worst - SLACK)[:, None]) | (norms == 0)[:, None]
        # By Cauchy and Schwarz a row's product is off its pivot's by at most the distance between them.
        best = unit @ self.pivots.T + self.most * (1 + SLACK) + SLACK * (1 + self.norms)
        return best < worst[:, None]


def _at_unit_length(vectors: np.ndarray) -> np.ndarray:
    norms = lengths(vectors)
    return vectors / np.where(norms > 0, norms, 1.0)[:, None]


def _pivots(table: DataFrame, rows: int, dimensions: int, unit: bool, block_bytes: int) -> np.ndarray:
    """Pivots amid a spread sample of the rows, whose size in bytes is bounded by ``block_bytes``."""
    vector_bytes = 8 * max(1, dimensions)
    cells = min(MOST_CELLS, CELLS_PER_BLOCK * (1 + rows * vector_bytes // block_bytes), max(1, block_bytes // (4 * vector_bytes)))
    wanted = max(1, min(SAMPLE_PER_CELL * cells, block_bytes // vector_bytes))
    one_in = max(1, rows // wanted)
    sample = table.filter(F.pmod(F.xxhash64("index"), F.lit(one_in)) == 0).select("vector").toArrow()
    found = matrix(sample.column("vector"), dimensions) if sample.num_rows else np.zeros((0, dimensions))
    found = found[finite_rows(found)]
    found = np.unique(_at_unit_length(found) if unit else found, axis=0)
    if not len(found):
        return np.zeros((1, dimensions))
    pivots = found[np.random.default_rng(7).permutation(len(found))[:cells]]
    for _ in range(PIVOT_STEPS if len(found) > len(pivots) else 0):
        nearest, _ = nearest_centre(found, pivots)
        held = np.bincount(nearest, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, found)
        pivots = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], pivots)
    return pivots


def _dealt(table: DataFrame, pivots: np.ndarray, unit: bool) -> DataFrame:
    """The rows with their cell and their distance to its pivot, as they are and at unit length."""
    shared = table.sparkSession.sparkContext.broadcast(pivots)
    unit_pivots = _at_unit_length(pivots)

    def deal(batches: Batches) -> Batches:
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"), pivots.shape[1])
            finite = finite_rows(vectors)
            if not finite.all():
                batch, vectors = batch.filter(pa.array(finite)), vectors[finite]
            ones = _at_unit_length(vectors)
            cell, _ = nearest_centre(ones if unit else vectors, pivots)
            apart = lengths(vectors - pivots[cell])
            # A vector without length has no angle and bounds none.
            unit_apart = np.where(lengths(vectors) > 0, lengths(ones - unit_pivots[cell]), 0.0)
            columns = [batch.column(c) for c in ("index", "word", "vector")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(unit_apart)],
                ["index", "word", "vector", "cell", "apart", "unit_apart"],
            )

    kinds = "index long, word string, vector array<double>, cell int, apart double, unit_apart double"
    return table.select("index", "word", "vector").mapInArrow(deal, kinds)


def _described(dealt: DataFrame, pivots: np.ndarray) -> Cells:
    found = dealt.groupBy("cell").agg(
        F.count(F.lit(1)).alias("held"), F.min("apart").alias("least"), F.max("apart").alias("most"), F.max("unit_apart").alias("unit_most")
    )
    known = found.toArrow()
    cell = known.column("cell").to_numpy()
    columns = []
    for name, absent in (("held", 0), ("least", np.inf), ("most", 0.0), ("unit_most", 0.0)):
        values = np.full(len(pivots), absent, dtype=np.int64 if name == "held" else np.float64)
        values[cell] = known.column(name).to_numpy()
        columns.append(values)
    return Cells(pivots, *columns)


@dataclass
class Search:
    """The two rounds of a search, stored as they go."""

    cells: Cells
    dealt: DataFrame
    queries: DataFrame
    first: DataFrame
    second: DataFrame
    answers: DataFrame

    def pairs(self) -> tuple[int, int]:
        """Pairs of a query and a cell that were joined, and all there are."""
        joined = self.first.count() + (self.second.agg(F.sum("left")).head()[0] or 0)
        return joined, self.queries.count() * int((self.cells.held > 0).sum())


def search(table: DataFrame, queries: DataFrame, n: int, metrics: list[str], schema: T.StructType, block_bytes: int) -> Search:
    """Candidates (the columns of ``schema``) that hold the ``n`` best rows of every query.

    ``table`` has ``index, word, vector``, ``queries`` has ``qid, vector``; the keys are unique. The table is stored once with
    its cells. In the first round a cell beyond ``ROUND_BYTES`` is cut into parts by hash of the index (it may hold many
    copies of one vector), the queries of a cell beyond it into chunks by hash of the qid, and one task meets one part with one
    chunk; in the second, one run of cells with one chunk of the queries that reach it. What is copied to the tasks is one
    pivot per cell, at most a quarter of ``block_bytes``.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).head()
    dimensions, spark = size["d"] or 0, table.sparkSession
    unit = all(m not in DISTANCES for m in metrics)
    pivots = _pivots(table, size["n"], dimensions, unit, block_bytes)
    dealt = settled(_dealt(table, pivots, unit))
    cells = _described(dealt, pivots)
    # Plain arrays, so that the workers need not have this package.
    shared = spark.sparkContext.broadcast((pivots, cells.held, cells.least, cells.most, cells.unit_most))
    kinds = queries.schema["qid"].dataType.simpleString()

    def go_home(batches: Batches) -> Batches:
        cells = Cells(*shared.value)
        step = max(1, ROUTED_CELLS // len(cells.held))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                vectors = matrix(part.column("vector"), cells.pivots.shape[1])
                safe = np.where(finite_rows(vectors)[:, None], vectors, 0.0)
                homes = [cells.home(safe, n, False)] if any(m in DISTANCES for m in metrics) else []
                if any(m not in DISTANCES for m in metrics):
                    homes.append(cells.home(_at_unit_length(safe), n, True))
                both = [np.unique(np.concatenate(found)).tolist() for found in zip(*homes)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid"), part.column("vector"), pa.array(both, pa.list_(pa.int32()))], ["qid", "vector", "home"]
                )

    routed = settled(queries.select("qid", "vector").mapInArrow(go_home, f"qid {kinds}, vector array<double>, home array<int>"))
    first = routed.select(F.col("qid").alias("asked_id"), F.col("vector").alias("asked"), F.explode("home").alias("cell"))
    found = settled(_met(dealt, cells, first, n, metrics, schema, dimensions))
    worst = _worst_places(found, n)
    left = routed.join(worst, "qid", "left")
    line = _line(cells, _sides(int(cells.held.sum()), dimensions))
    cover = spark.sparkContext.broadcast(line.cover())

    def go_on(batches: Batches) -> Batches:
        cells = Cells(*shared.value)
        width = cells.pivots.shape[1]
        step = max(1, ROUTED_CELLS // (len(cells.held) * max(1, width)) + 1)
        used = cells.held > 0
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                vectors = matrix(part.column("vector"), width)
                reached = np.zeros((len(vectors), len(used)), dtype=bool)
                with np.errstate(all="ignore"):
                    for at, metric in enumerate(metrics):
                        limit = part.column(f"worst{at}").to_numpy(zero_copy_only=False).astype(np.float64)
                        reached |= ~cells.out_of_reach(vectors, metric, limit)
                reached &= used
                for row, home in enumerate(part.column("home").to_pylist()):
                    reached[row, home] = False
                runs = (reached.astype(np.float32) @ cover.value) > 0
                asks = np.flatnonzero(runs.any(axis=1))
                if len(asks):
                    kept, reached, runs = part.take(pa.array(asks)), reached[asks], runs[asks]
                    ends = np.r_[0, np.cumsum(runs.sum(axis=1))].astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(runs)[1].astype(np.int32)))
                    counts = pa.array(reached.sum(axis=1).astype(np.int64))
                    bits = pa.array([row.tobytes() for row in np.packbits(reached, axis=1)], pa.binary())
                    limits = [kept.column(f"worst{at}") for at in range(len(metrics))]
                    yield pa.RecordBatch.from_arrays(
                        [kept.column("qid"), kept.column("vector"), bits, counts, listed, *limits],
                        ["asked_id", "asked", "reached", "left", "runs", *[f"worst{at}" for at in range(len(metrics))]],
                    )

    limits = [F.col("worst")[m].alias(f"worst{at}") for at, m in enumerate(metrics)]
    kinds = f"asked_id {kinds}, asked array<double>, reached binary, left long, runs array<int>"
    kinds += "".join(f", worst{at} double" for at in range(len(metrics)))
    second = settled(left.select("qid", "vector", "home", *limits).mapInArrow(go_on, kinds))
    more = _met_in_tiles(dealt, line, second, n, metrics, schema, dimensions)
    return Search(cells, dealt, routed, first, second, found.unionByName(more))


@dataclass
class Line:
    """All rows in a line, cell by cell, cut into ``runs`` of equal length; a large cell may lie in several."""

    start: np.ndarray
    held: np.ndarray
    runs: int

    @property
    def rows(self) -> int:
        return max(1, int(self.held.sum()))

    def cover(self) -> np.ndarray:
        """Which runs (columns) hold rows of which cells."""
        first = self.start * self.runs // self.rows
        last = (self.start + self.held - 1) * self.runs // self.rows
        at = np.arange(self.runs)
        return ((at >= first[:, None]) & (at <= last[:, None]) & (self.held > 0)[:, None]).astype(np.float32)


def _line(cells: Cells, runs: int) -> Line:
    """The cells in an order that keeps near pivots together: by their place along the direction in which pivots vary most."""
    used = cells.held > 0
    centred = np.where(used[:, None], cells.pivots - cells.pivots[used].mean(axis=0) if used.any() else 0.0, 0.0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if centred.size else np.zeros(len(used))
    order = np.argsort(along, kind="stable")
    start = np.empty(len(used), dtype=np.int64)
    start[order] = np.cumsum(cells.held[order]) - cells.held[order]
    return Line(start, cells.held, runs)


def _sides(rows: int, dimensions: int) -> int:
    """Into how many parts a side of so many rows is cut."""
    held = rows * (8 * max(1, dimensions) + 64)
    return max(1, min(SIDE, held // LEAST_TILE_BYTES), -(-held // TILE_BYTES))


def _met_in_tiles(
    dealt: DataFrame, line: Line, asked: DataFrame, n: int, metrics: list[str], schema: T.StructType, dimensions: int
) -> DataFrame:
    """The best rows of each run of cells for each chunk of the queries that reach it, none worse than the queries hold."""
    spark, long = dealt.sparkSession, pa.int64()
    cells = pa.table({"cell": pa.array(np.arange(len(line.held)), pa.int32()), "start": pa.array(line.start, long), "held": pa.array(line.held, long)})
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, start long, held long"))
    each = asked.select(F.explode("runs").alias("run"))
    counts = {r["run"]: r["count"] for r in each.groupBy("run").count().collect()}
    # One row per run.
    plan = [(run, _sides(count, dimensions)) for run, count in sorted(counts.items())]
    tiles = max(1, sum(chunks for _, chunks in plan))
    plan = F.broadcast(spark.createDataFrame(plan, "run int, chunks long"))
    place = F.col("start") + F.pmod(F.xxhash64("index"), "held")
    rows = dealt.join(cells, "cell").select("cell", "index", "word", "vector", place.alias("place"))
    rows = rows.withColumn("run", F.expr(f"cast(place * {line.runs}L div {line.rows}L as int)")).drop("place").join(plan, "run")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    limits = [f"worst{at}" for at in range(len(metrics))]
    queries = asked.select("asked_id", "asked", "reached", *limits, F.explode("runs").alias("run")).join(plan, "run")
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("asked_id"), "chunks")).drop("chunks")
    keys, parts = ["run", "chunk"], PARTITIONS_PER_TILE * tiles

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _no_answers(right)
        vectors = matrix(right.column("asked"))
        limits = [right.column(f"worst{at}").to_numpy().astype(np.float64) for at in range(len(metrics))]
        bests = [Best(vectors, n, m, limit) for m, limit in zip(metrics, limits)]
        directions = bests[0].directions()
        bits = np.frombuffer(b"".join(right.column("reached").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        left = left.combine_chunks()
        cell = left.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        present, starts = np.unique(cell[order], return_index=True)
        asks = {c: np.flatnonzero(bits[:, c // 8] & (128 >> c % 8)) for c in present.tolist()}
        shared = [c for c in asks if len(asks[c]) == len(vectors)]
        # Cells that every query reaches are scored as one, so that their rows of near length lie together.
        groups = [(np.flatnonzero(np.isin(cell, shared)), None)] if shared else []
        for c, some in zip(present.tolist(), np.split(order, starts[1:])):
            if c not in shared and len(asks[c]):
                groups.append((some, asks[c]))
        for some, chosen in groups:
            for block in read_blocks(left.take(pa.array(some)).to_batches(), vectors.shape[1]):
                scan_block(bests, block, directions, chosen)
        return pa.Table.from_batches(list(best_answers(bests, right.column("asked_id").combine_chunks())))

    # By number, so that small tables keep their tiles apart: their work is the product of their sides.
    rows, queries = rows.repartition(parts, *keys), queries.repartition(parts, *keys)
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(score, schema)


def _no_answers(asked: pa.Table) -> pa.Table:
    types = (asked.schema.field("asked_id").type, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64())
    return pa.table([pa.array([], t) for t in types], ANSWERS)


def _worst_places(found: DataFrame, n: int) -> DataFrame:
    """``qid, worst``: per metric the score in the last of the ``n`` places; queries with free places have no entry."""
    key = F.when(F.col("metric").isin(*DISTANCES), F.col("score")).otherwise(-F.col("score"))
    last = top_n_per_group(found.drop("rank"), ["qid", "metric"], [key, F.col("index")], n).filter(F.col("rank") == n)
    return last.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("worst"))


def _met(
    dealt: DataFrame, cells: Cells, pairs: DataFrame, n: int, metrics: list[str], schema: T.StructType, dimensions: int
) -> DataFrame:
    """The best rows of each part of a cell for each chunk of the queries sent to it."""
    spark, row_bytes = dealt.sparkSession, 8 * max(1, dimensions) + 64
    asked = pairs.groupBy("cell").count().toArrow()
    cell = asked.column("cell").to_numpy()
    parts = 1 + cells.held[cell] * row_bytes // ROUND_BYTES
    chunks = 1 + asked.column("count").to_numpy() * row_bytes // ROUND_BYTES
    # One row per cell, of which there are at most MOST_CELLS.
    plan = pa.table({"cell": pa.array(cell.astype(np.int32)), "parts": pa.array(parts), "chunks": pa.array(chunks)})
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, parts long, chunks long"))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    rows = dealt.join(plan, "cell").select("cell", "index", "word", "vector", F.pmod(F.xxhash64("index"), "parts").alias("part"), every("chunks").alias("chunk"))
    queries = pairs.join(plan, "cell").select("cell", "asked_id", "asked", F.pmod(F.xxhash64("asked_id"), "chunks").alias("chunk"), every("parts").alias("part"))
    keys = ["cell", "part", "chunk"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _no_answers(right)
        vectors = matrix(right.column("asked"))
        bests = [Best(vectors, n, m) for m in metrics]
        directions = bests[0].directions()
        for block in read_blocks(left.to_batches(), vectors.shape[1]):
            scan_block(bests, block, directions)
        return pa.Table.from_batches(list(best_answers(bests, right.column("asked_id").combine_chunks())))

    # By number, so that small tables are not met by few tasks: the work is the product of the sides.
    shares = int((parts * chunks).sum())
    dealt_to = max(1, min(PARTITIONS_PER_TILE * shares, max(ROUND_PARTITIONS, shares // 4)))
    rows, queries = rows.repartition(dealt_to, *keys), queries.repartition(dealt_to, *keys)
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(score, schema)


def read_blocks(batches: Batches, dimensions: int | None) -> Iterator[Block]:
    """Batches of the word table for scoring, small ones pooled; words stay in Arrow until one of them is an answer.

    Rows with an element that is no finite number are never ranked.
    """
    pool, held = [], 0
    for batch in batches:
        if batch.num_rows:
            pool.append(batch)
            held += batch.column("vector").nbytes
        if held >= POOLED_BYTES:
            yield _block(pool, dimensions)
            pool, held = [], 0
    if pool:
        yield _block(pool, dimensions)


def _block(batches: list[pa.RecordBatch], dimensions: int | None) -> Block:
    table = pa.Table.from_batches(batches).select(["index", "word", "vector"]).combine_chunks()
    vectors = matrix(table.column("vector"), dimensions)
    finite = finite_rows(vectors)
    if not finite.all():
        table, vectors = table.filter(pa.array(finite)).combine_chunks(), vectors[finite]
    words = table.column("word")
    words = words.chunk(0) if words.num_chunks else pa.array([], pa.string())
    return Block(table.column("index").to_numpy(), Words(words), vectors)


def best_answers(bests: list[Best], qids: pa.Array) -> Iterator[pa.RecordBatch]:
    for best in bests:
        query, rank, index, word, score = best.results()
        yield pa.RecordBatch.from_arrays(
            [
                qids.take(pa.array(query)),
                pa.array([best.metric] * len(query), pa.string()),
                pa.array(rank, pa.int32()),
                pa.array(index),
                pa.array(word, pa.string()),
                pa.array(score),
            ],
            ANSWERS,
        )
