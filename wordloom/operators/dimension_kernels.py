"""Numpy helpers that reduce the vectors of one Spark task to a few rows per model and dimension.

Exploding every vector element into a row costs far more than the statistics themselves, so each task counts its own
elements and only the counts are shuffled. The vectors arrive as Arrow batches of ``model, vector``; several models share
a pass. What a task holds grows with the models and dimensions, and with the bins that really hold an element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.operators.kernels import matrix

Batches = Iterator[pa.RecordBatch]

# Bins with their counts that a task keeps apart before it adds them up.
HELD_BINS = 1_000_000


def _columns(batches: Batches) -> Iterator[tuple[str, np.ndarray]]:
    """The batches by model, as dimensions x rows matrices."""
    for batch in batches:
        models = batch.column("model")
        for model in pc.unique(models).to_pylist():
            own = batch if pc.all(pc.equal(models, model)).as_py() else batch.filter(pc.equal(models, model))
            yield model, np.ascontiguousarray(matrix(own.column("vector")).T)


def _batch(model: str, **columns: pa.Array) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([model] * rows, pa.string()), *columns.values()], ["model", *columns])


def moments(batches: Batches) -> Batches:
    """``model, dimension, size, n, mean, squares, min, max`` of the task: the size of its vectors, and the sum of squared
    deviations from its mean."""
    held: dict[str, tuple] = {}
    for model, columns in _columns(batches):
        m = columns.shape[1]
        n, mean, squares, low, high = held.get(model, (0, 0.0, 0.0, np.inf, -np.inf))
        if n and len(columns) != len(mean):
            raise ValueError(f"vector sizes differ: {len(mean)} and {len(columns)}")
        part = columns.mean(axis=1)
        shift = part - mean
        squares = squares + ((columns - part[:, None]) ** 2).sum(axis=1) + shift**2 * (n * m / (n + m))
        mean = mean + shift * (m / (n + m))
        held[model] = n + m, mean, squares, np.minimum(low, columns.min(axis=1)), np.maximum(high, columns.max(axis=1))
    for model, (n, mean, squares, low, high) in held.items():
        d = len(mean)
        yield _batch(
            model,
            dimension=pa.array(np.arange(d), pa.int32()),
            size=pa.array(np.full(d, d), pa.int32()),
            n=pa.array(np.full(d, n)),
            mean=pa.array(mean),
            squares=pa.array(squares),
            min=pa.array(low),
            max=pa.array(high),
        )


def _by_model(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    for model in pc.unique(table.column("model")).to_pylist():
        yield model, table.filter(pc.equal(table.column("model"), model)).sort_by("dimension")


def equal_width_counts(ends: pa.Table, bins: int) -> Callable[[Batches], Batches]:
    """``model, dimension, bin, count``: elements per equal-width bin between the ``min`` and ``max`` of ``ends``; the highest
    value belongs to the last bin, and to the first when all are equal."""
    known = {model: (own.column("min").to_numpy(), own.column("max").to_numpy()) for model, own in _by_model(ends)}

    def count(batches: Batches) -> Batches:
        counts: dict[str, np.ndarray] = {}
        for model, columns in _columns(batches):
            low, high = known[model]
            width = (high - low) / bins
            with np.errstate(divide="ignore", invalid="ignore"):
                place = np.floor((columns - low[:, None]) / width[:, None])
            place = np.where(columns == high[:, None], bins - 1, np.minimum(place, bins - 1))
            place = np.where(columns == low[:, None], 0, place).astype(np.int64)
            place += np.arange(len(low))[:, None] * bins
            added = np.bincount(place.ravel(), minlength=len(low) * bins)
            counts[model] = counts[model] + added if model in counts else added
        for model, held in counts.items():
            used = np.flatnonzero(held)
            dimension, place = np.divmod(used, bins)
            yield _batch(
                model, dimension=pa.array(dimension, pa.int32()), bin=pa.array(place, pa.int32()), count=pa.array(held[used])
            )

    return count


class Ranges:
    """Disjoint ranges of values per dimension of one model, with the number of values below each."""

    def __init__(self, table: pa.Table, low: str, high: str, below: str):
        dimension, lows = table.column("dimension").to_numpy(), table.column(low).to_numpy()
        order = np.lexsort((lows, dimension))
        self.dimension, self.low = dimension[order], lows[order]
        self.high, self.below = table.column(high).to_numpy()[order], table.column(below).to_numpy()[order]
        self.dimensions = np.unique(self.dimension)
        self.first = np.searchsorted(self.dimension, self.dimensions)
        self.after = np.searchsorted(self.dimension, self.dimensions, side="right")

    def inside(self, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each dimension, the positions of the ranges hit and the values in them."""
        for dimension, first, after in zip(self.dimensions, self.first, self.after):
            values = columns[dimension]
            at = np.searchsorted(self.low[first:after], values, side="right") - 1 + first
            hit = (at >= first) & (values <= self.high[np.maximum(at, first)])
            yield at[hit], values[hit]


def ranges_by_model(table: pa.Table, low: str, high: str, below: str) -> dict[str, Ranges]:
    return {model: Ranges(own, low, high, below) for model, own in _by_model(table)}


class Bins:
    """Counts and spans of the bins that hold an element: sorted bin numbers, each with its count, least and greatest value."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, place: np.ndarray, values: np.ndarray) -> None:
        self._keep(place, np.ones(len(place), np.int64), values, values)

    def _keep(self, *part: np.ndarray) -> None:
        self.parts.append(self._summed(*part))
        self.waiting += len(self.parts[-1][0])
        if len(self.parts) > 1 and self.waiting > HELD_BINS:
            self.total()

    @staticmethod
    def _summed(place: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(place):
            return place, held, low, high
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        reduced = (f.reduceat(x[order], starts) for f, x in ((np.add, held), (np.minimum, low), (np.maximum, high)))
        return (place[starts], *reduced)

    def total(self) -> tuple[np.ndarray, ...]:
        self.parts = [self._summed(*(np.concatenate(column) for column in zip(*self.parts)))]
        # What is left after adding up is not counted again, so many full bins do not add up at every batch.
        self.waiting = 0
        return self.parts[0]


def refining_counts(ranges: dict[str, Ranges], bins: int) -> Callable[[Batches], Batches]:
    """``model, dimension, base, bin, low, high, held``: count and span of the elements in each bin of each range."""

    def count(batches: Batches) -> Batches:
        held: dict[str, Bins] = {}
        with np.errstate(all="ignore"):
            for model, columns in _columns(batches):
                own = ranges.get(model)
                for at, values in own.inside(columns) if own else ():
                    start, end = own.low[at], own.high[at]
                    share = np.nan_to_num((values * 0.5 - start * 0.5) / (end * 0.5 - start * 0.5), nan=0.0, posinf=0.0)
                    place = np.clip(np.floor(np.maximum(share, 0.0) * bins), 0, bins - 2).astype(np.int64)
                    held.setdefault(model, Bins()).add(np.where(values >= end, bins - 1, place) + at * bins, values)
        for model, found in held.items():
            place, counts, low, high = found.total()
            own, at = ranges[model], place // bins
            yield _batch(
                model,
                dimension=pa.array(own.dimension[at], pa.int32()),
                base=pa.array(own.below[at]),
                bin=pa.array(place % bins, pa.int32()),
                low=pa.array(low),
                high=pa.array(high),
                held=pa.array(counts),
            )

    return count


def values_inside(ranges: dict[str, Ranges]) -> Callable[[Batches], Batches]:
    """``model, dimension, below, value, copies``: the distinct elements of each batch that fall in a range."""

    def pick(batches: Batches) -> Batches:
        for model, columns in _columns(batches):
            own = ranges.get(model)
            parts = [found for found in own.inside(columns) if len(found[0])] if own else []
            if not parts:
                continue
            at, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((values, at))
            at, values = at[order], values[order]
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (values[1:] != values[:-1])])
            copies = np.diff(np.r_[starts, len(at)])
            at, values = at[starts], values[starts]
            yield _batch(
                model,
                dimension=pa.array(own.dimension[at], pa.int32()),
                below=pa.array(own.below[at]),
                value=pa.array(values),
                copies=pa.array(copies),
            )

    return pick
