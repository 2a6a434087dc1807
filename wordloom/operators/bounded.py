"""K-means steps that compare a row with a centre only where its cluster may have changed.

Each row is stored with its cluster, an upper bound of the distance to its own centre and, for each group of centres, a
lower bound of the distance to every other centre of the group. A centre that moves by m changes a distance by at most m,
so after a step the upper bound grows by the own centre's move and a group's lower bound falls by the largest move in it.
A row whose upper bound is below all its lower bounds keeps its cluster unseen; of another, only the groups whose lower
bound does not exceed the upper bound are compared. Distances that decide are exact, so clusters are those of a full
comparison, lowest cluster among equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import BROADCAST_BYTES, discard, scratch
from wordloom.operators.clustering import (
    SUMS,
    _centre_matrix,
    _centroid_table,
    _finite,
    _means,
    _sums_per_task,
    _warm_start_by_blocks,
)
from wordloom.operators.kernels import lengths, list_column, matrix, nearest_centre

# Groups of centres with a lower bound of their own; fewer where there are few centres.
GROUPS = 16
GROUP_CENTRES = 8
# Bounds are widened by these shares, far more than rounding can move them: when made from a distance, and by a step.
SLACK = 1e-9
STEP_SLACK = 1e-12

# The cluster is the position of its id in ascending order.
STATE = "cluster int, upper double, lower array<double>, compared bigint, vector array<double>"


def kmeans_with_bounds(
    df: DataFrame,
    centroids: DataFrame,
    iterations: int,
    tolerance: float = 1e-4,
    groups: int = GROUPS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, list[float]]:
    """As ``clustering.kmeans_warm_start``, with the share of all distances that each step computed.

    A step reads the stored rows once to renew them and once for the sums, which costs more than the distances where
    there are few centres; it is meant for thousands of them. A step's rows are written before those of the step
    before are deleted, so a lost executor costs its tasks only. Rows with an element that is no finite number have no
    cluster and are not stored; equal rows are kept; an empty table leaves the centres as they are. Centres that do not fit
    in ``broadcast_bytes`` take plain steps, and no shares are given.
    """
    held = _centre_matrix(df, centroids, broadcast_bytes)
    if held is None:
        return _warm_start_by_blocks(df, centroids, iterations, tolerance), []
    ids, centres = held
    spark = df.sparkSession
    state, stored, shares = df.select("vector"), None, []
    members, moves = _grouped(centres, groups), np.zeros(len(centres))
    for _ in range(iterations if len(centres) else 0):
        path = scratch(spark, "bounds")
        _renewed(state, centres, members, moves).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if stored is not None:
            discard(spark, stored)
        stored = path
        compared, rows = state.agg(F.sum("compared"), F.count(F.lit(1))).head()
        shares.append(compared / (rows * len(centres)) if rows else 0.0)
        means = _means(state.select("cluster", "vector").mapInArrow(_sums_per_task, SUMS)).toArrow()
        moved = centres.copy()
        if means.num_rows:
            moved[means.column("cluster").to_numpy()] = matrix(means.column("mean"), centres.shape[1])
        moves, centres = lengths(moved - centres), moved
        if moves.max() <= tolerance:
            break
    if stored is not None:
        discard(spark, stored)
    return _centroid_table(spark, (ids, centres)), shares


def _grouped(centres: np.ndarray, groups: int) -> list[np.ndarray]:
    """Positions of the centres in each group, ascending: those that are nearest to one of evenly spaced centres."""
    if not len(centres):
        return []
    count = max(1, min(groups, len(centres) // GROUP_CENTRES))
    pivots = centres[np.linspace(0, len(centres) - 1, count).astype(np.int64)]
    nearest, _ = nearest_centre(centres, pivots)
    return [np.flatnonzero(nearest == g) for g in np.unique(nearest)]


def _renewed(state: DataFrame, centres: np.ndarray, members: list[np.ndarray], moves: np.ndarray) -> DataFrame:
    """The rows with their clusters and bounds for centres that have moved; rows without bounds get their first."""
    shared = state.sparkSession.sparkContext.broadcast((centres, members, moves))

    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, members, moves = shared.value
        farthest = np.array([moves[own].max() for own in members])
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"), centres.shape[1])
            if "cluster" in batch.schema.names:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper = batch.column("upper").to_numpy() * (1 + STEP_SLACK) + moves[cluster] * (1 + SLACK)
                lower = matrix(batch.column("lower"), len(members)) * (1 - STEP_SLACK) - farthest * (1 + SLACK)
            else:
                vectors, odd = _finite(vectors)
                vectors = vectors[~odd]
                cluster = np.full(len(vectors), -1, dtype=np.int64)
                upper, lower = np.full(len(vectors), np.inf), np.zeros((len(vectors), len(members)))
            compared = reassign(vectors, cluster, upper, lower, centres, members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(upper), list_column(lower), pa.array(compared), list_column(vectors)],
                ["cluster", "upper", "lower", "compared", "vector"],
            )

    return state.mapInArrow(renew, STATE)


def reassign(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, members: list[np.ndarray]
) -> np.ndarray:
    """Bring ``cluster``, ``upper`` and ``lower`` up to date in place; returns how many centres each row was compared with.

    A row without a cluster has -1 and an infinite upper bound. A group's lower bound leaves out the row's own centre.
    """
    compared = np.zeros(len(vectors), dtype=np.int64)
    rows = np.flatnonzero(upper >= lower.min(axis=1, initial=np.inf))
    own_squared = np.full(len(vectors), np.inf)
    known = rows[cluster[rows] >= 0]
    own_squared[known] = ((vectors[known] - centres[cluster[known]]) ** 2).sum(axis=1)
    upper[known] = np.sqrt(own_squared[known]) * (1 + SLACK)
    compared[known] += 1
    rows = rows[upper[rows] >= lower[rows].min(axis=1, initial=np.inf)]
    before, squared = cluster[rows], own_squared[rows]
    now, least, bounds = before.copy(), squared.copy(), lower[rows]
    wanted = bounds <= upper[rows][:, None]
    nearest, beyond = np.full(bounds.shape, -1, dtype=np.int64), np.zeros(bounds.shape)
    for g, own in enumerate(members):
        some = np.flatnonzero(wanted[:, g])
        if not len(some):
            continue
        beyond_own = np.empty(len(some))
        position, distance = nearest_centre(vectors[rows[some]], centres[own], beyond_own)
        nearest[some, g], beyond[some, g] = own[position], beyond_own
        bounds[some, g] = np.sqrt(distance) * (1 - SLACK)
        compared[rows[some]] += len(own)
        better = (distance < least[some]) | ((distance == least[some]) & (own[position] < now[some]))
        now[some[better]], least[some[better]] = own[position][better], distance[better]
    # Where a group's nearest is the own centre, the bound is that of the others.
    is_own = wanted & (nearest == now[:, None])
    bounds[is_own] = np.sqrt(beyond[is_own]) * (1 - SLACK)
    # A centre that a row has left counts again in its group, also where the group was not compared.
    group = np.empty(len(centres), dtype=np.int64)
    for g, own in enumerate(members):
        group[own] = g
    left = np.flatnonzero((now != before) & (before >= 0))
    bounds[left, group[before[left]]] = np.minimum(bounds[left, group[before[left]]], np.sqrt(squared[left]) * (1 - SLACK))
    cluster[rows], upper[rows], lower[rows] = now, np.sqrt(least) * (1 + SLACK), bounds
    return compared
