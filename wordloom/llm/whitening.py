"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows, products taken by Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled

COMPONENTS = 4
SCALE = 256
SEED = 29
# A triplet is settled once its residual is below this share of the largest deviation; a direction whose deviation is
# below the second share of the largest is no component, as rounding alone makes such.
SETTLED = 1e-14
NOTHING = 1e-9

Batches = Iterator[pa.RecordBatch]


@dataclass
class Fit:
    """What the fit list is centred by: its size, sums per dimension (whole numbers) and the bound on an entry."""

    n: int
    sums: list[int]
    largest: int

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and remainders below 1, so that no digits are lost beside large entries."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x``: vectors without absent or non-finite entries, each entry times 256 rounded down to a long.

    Vectors that are absent or hold no entries are left out as well.
    """
    number = f"""{column} is not null and size({column}) > 0
        and not exists({column}, c -> c is null or isnan(c) or abs(c) = double('infinity'))"""
    kept = vectors.select("vec_id", column).filter(F.expr(number))
    return kept.select("vec_id", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _rows(column) -> np.ndarray:
    """An Arrow column of whole vectors as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and np.any(sizes != sizes[0]):
        raise ValueError(f"vector sizes differ: {sorted(set(sizes.tolist()))}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(column, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    whole, rest = mean
    return (_rows(column) - whole).astype(np.float64) - rest


def _summed(rows: DataFrame, part, kind: str = "double") -> np.ndarray:
    """Sum of the vectors that ``part`` makes of the tasks' matrices; adds by position, so the driver gets one vector."""

    def run(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(batch.column("x"))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    added = rows.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum(_exact(kind)).alias("value"))
    return np.array([r["value"] for r in sorted(added.collect())], dtype=object if kind == "long" else np.float64)


def _exact(kind: str) -> Column:
    return F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")


def fit_list(x: DataFrame) -> tuple[DataFrame, Fit | None]:
    """The distinct vectors, stored, and what centres them; None for an empty table.

    Copies meet before the shuffle, so a vector that fills a third of the rows costs one row per task.
    """
    rows = settled(x.select("x").distinct())
    size = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).head()
    if not size[0]:
        return rows, None
    if size[1] != size[2]:
        raise ValueError(f"vector sizes differ: {size[1]} and {size[2]}")

    def halves(column) -> np.ndarray:
        # Upper and lower halves apart, so that no sum of a task can overflow.
        m = _rows(column)
        return np.concatenate([(m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)])

    sums = [int(s) for s in _summed(rows, halves, "long")]
    d = len(sums) // 2
    exact = [(high << 32) + low for high, low in zip(sums[:d], sums[d:])]
    return rows, Fit(size[0], exact, max(abs(size[3]), abs(size[4])))


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along an orthonormal basis, taken out twice against rounding."""
    for _ in range(2):
        for b in basis:
            v = v - b * (b @ v)
    return v


def _start(d: int, basis: list[np.ndarray], rng: np.random.Generator) -> np.ndarray | None:
    """A random direction orthogonal to ``basis``; None when there is none left."""
    if len(basis) >= d:
        return None
    v = _orthogonal(rng.standard_normal(d), basis)
    return v / np.linalg.norm(v)


def bidiagonalised(rows: DataFrame, fit: Fit, known: list[np.ndarray], wanted: int, above: float, seed: int = SEED):
    """Right singular vectors and singular values of the centred rows in the complement of ``known``, largest first.

    A step takes the product u = Xv less its part along the step before, and X'u, in one pass: a row's entry of u needs
    that row alone, so entries are never stored but made again from weights w with u = Xw. The inner products with all
    earlier u come out of the same pass; both sides are reorthogonalised in full. The d-long vectors and the small
    bidiagonal matrix are the driver's. Steps end when the first ``wanted`` triplets have settled, when nothing is
    left (at most after d steps), or when even the largest value is seen to stay below ``above``.
    """
    d, mean, rng = len(fit.sums), fit.mean, np.random.default_rng(seed + len(known))
    v = _start(d, known, rng)
    right, weights, alphas, betas = [], [], [], []
    products: list[np.ndarray] = []  # X'u of the steps so far
    p = v
    while v is not None:
        right.append(v)
        earlier = np.array(weights).reshape(len(weights), d).T

        def step(column, p=p, earlier=earlier):
            m = _centred(column, mean)
            u = m @ p
            return np.concatenate([u @ m, (m @ earlier).T @ u, [u @ u]])

        out = _summed(rows, step)
        back, inner, square = out[:d], out[d:-1], out[-1]
        # Take out what rounding has left of the earlier u's.
        for c, w, b in zip(inner, weights, products):
            p, back = p - c * w, back - c * b
        alpha = math.sqrt(max(0.0, square - float(inner @ inner)))
        top = max([alpha, *alphas])
        if alpha <= NOTHING * 1e-3 * top or alpha == 0.0:
            alphas.append(0.0)
            betas.append(0.0)
            weights.append(np.zeros(d))
            break
        alphas.append(alpha)
        weights.append(p / alpha)
        products.append(back / alpha)
        rest = _orthogonal(products[-1] - alpha * v, known + right)
        beta = float(np.linalg.norm(rest))
        betas.append(beta)
        left, values, _ = np.linalg.svd(_bidiagonal(alphas, betas))
        residual = beta * np.abs(left[-1])
        count = min(wanted, len(values))
        if len(values) >= wanted and np.all(residual[:count] <= SETTLED * values[0]):
            break
        if len(values) > 8 and residual[0] < 1e-3 * values[0] and values[0] + residual[0] < above:
            break
        if beta <= SETTLED * values[0] or len(right) + len(known) >= d:
            break
        v = rest / beta
        p = v - beta * weights[-1]
    if not right:
        return []
    _, values, rotation = np.linalg.svd(_bidiagonal(alphas, betas))
    vectors = rotation @ np.array(right)
    return [(s, w / np.linalg.norm(w)) for s, w in zip(values, vectors)]


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def components(rows: DataFrame, fit: Fit, wanted: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Deviations and unit directions of the ``wanted`` largest components, largest first; fewer when there are no more.

    One run from one random start finds one direction for each singular value, however many share it. So further runs
    look into the complement of what is found, until their largest value is below the wanted ones.
    """
    found: list[tuple[float, np.ndarray]] = []
    while True:
        enough = len(found) >= wanted
        above = found[wanted - 1][0] if enough else 0.0
        new = bidiagonalised(rows, fit, [w for _, w in found], 1 if enough else wanted - len(found), above, seed)
        new = [(s, w) for s, w in new[: 1 if enough else wanted - len(found)] if s > max(above, NOTHING * max([s, *[f for f, _ in found]]))]
        if not new:
            break
        found = sorted(found + new, key=lambda f: -f[0])
    found = found[:wanted]
    deviations = np.array([s for s, _ in found]) / math.sqrt(fit.n)
    return deviations, np.array([w for _, w in found]).reshape(len(found), len(fit.sums))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, column: str = "embedding", seed: int = SEED) -> DataFrame:
    """The whitened vectors: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries times 256, rounded down, are fitted over the distinct vectors; a row per vector and component follows,
    components numbered from 1 by falling variance. ``deviation`` is exact: the sum of (n x - S)^2 over the dimensions,
    absent where it is beyond a long. ``identity_error`` is measured on the whitened fit list.

    Every pass reads the stored fit list once and sends one vector of the dimension's length per task; the components go
    to the tasks as a matrix of ``wanted`` by dimension. Absent vectors, those with absent or non-finite entries and those
    without entries are left out; repeated rows get rows of their own but count once in the fit; absent ids stay. Where
    all vectors are equal, or fewer directions vary than are wanted, there are no rows for the missing components; an
    empty table gives none. Vectors of different sizes fail. Columns beside the two are not read.
    """
    x = quantised(vectors, column)
    rows, fit = fit_list(x)
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double"
    deviations, directions = (np.zeros(0), np.zeros((0, 0))) if fit is None else components(rows, fit, wanted, seed)
    if not len(deviations):
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumns({"explained": F.lit(0.0), "identity_error": F.lit(0.0)})
    mean, matrix, count = fit.mean, directions / deviations[:, None], len(deviations)

    def measures(column) -> np.ndarray:
        m = _centred(column, mean)
        z = m @ matrix.T
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0), [(m * m).sum()]])

    out = _summed(rows, measures) / fit.n
    square, middle, trace = out[: count * count].reshape(count, count), out[count * count : -1], out[-1]
    identity_error = float(np.abs(square - np.outer(middle, middle) - np.eye(count)).max())
    n, sums = fit.n, fit.sums
    # Whether (n x - S)^2, summed, fits a long for every possible row.
    fits = (2 * n * fit.largest) ** 2 * len(sums) < 2**63
    total = np.array(sums, dtype=np.int64 if fits else object)

    def project(batches: Batches) -> Batches:
        for batch in batches:
            held = batch.num_rows
            if not held:
                continue
            z = _centred(batch.column("x"), mean) @ matrix.T
            m = _rows(batch.column("x"))
            apart = ((m if fits else m.astype(object)) * n - total) ** 2
            apart = [v if v < 2**63 else None for v in apart.sum(axis=1).tolist()]
            order = np.repeat(np.arange(held), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(order)),
                    pa.array(np.tile(np.arange(1, count + 1), held), pa.int32()),
                    pa.array(np.full(held * count, n), pa.int64()),
                    pa.array(apart, pa.int64()).take(pa.array(order)),
                    pa.array(z.ravel()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened"],
            )

    shares = F.array(*[F.lit(float(e)) for e in deviations**2 / trace])
    explained = F.get(shares, F.col("component") - 1)
    return x.mapInArrow(project, schema).withColumns({"explained": explained, "identity_error": F.lit(identity_error)})
