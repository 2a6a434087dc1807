"""Numpy helpers that score one Arrow batch of vectors against a block of others inside a Spark task.

Scores come from a matrix product. Its rounding depends on where a row sits in the block, so the product only
selects candidates, with a margin above its error bound; the candidates are then scored one pair at a time in
a fixed order. Equal vectors thus get equal scores, and ties are broken by the lowest index.

All metrics share one product of the directions, in single precision: the rows of a band have near lengths, so a
query's largest cosine in the band bounds every score there, and only the queries whose bound reaches their worst
place are looked at further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Scores worked on at once by one task, as a count of doubles: small enough to stay in a core's cache.
BLOCK_CELLS = 262_144
# The same for products in single precision, and the rows of near length that are multiplied together.
ROUGH_CELLS = 1_048_576
BAND_ROWS = 2048
# Lengths whose squares and quotients are far from the ends of the number range; other blocks take the product in full precision.
ORDINARY = (1e-100, 1e100)
# Numbers gathered at once for exact scores.
EXACT_CELLS = 4_000_000
NO_INDEX = np.iinfo(np.int64).max

DISTANCES = ("euclidean", "squared_euclidean")
LOWER_IS_BETTER = {"euclidean": True, "squared_euclidean": True, "cosine": False, "normalized_cosine": False}


def matrix(column, dimensions: int | None = None) -> np.ndarray:
    """An Arrow list column as a rows x dimensions matrix; fails when the sizes differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector is null")
    rows = len(column)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vector has a null element")
    sizes = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0, dtype=np.int64)
    width = dimensions if dimensions is not None else (int(sizes[0]) if rows else 0)
    if rows and np.any(sizes != width):
        raise ValueError(f"vector sizes differ: expected {width}, found {sorted(set(sizes.tolist()))}")
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, width)


def list_column(values: np.ndarray) -> pa.Array:
    """A rows x dimensions matrix as an Arrow list column."""
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def finite_rows(vectors: np.ndarray) -> np.ndarray:
    """Which rows hold finite numbers only."""
    return np.isfinite(vectors).all(axis=1)


def ordinary(norms: np.ndarray) -> bool:
    """Whether all lengths are zero or far from the ends of the number range."""
    return bool(np.all((norms == 0) | ((norms >= ORDINARY[0]) & (norms <= ORDINARY[1]))))


def directions(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The vectors at unit length in single precision; those without length stay zero."""
    return (vectors / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)


def rough_error(dimensions: int) -> float:
    """More than the error of a single-precision product of two directions, rounding of its factors included."""
    return 2.0 * (dimensions + 8) * float(np.finfo(np.float32).eps)


class Words:
    """Words of a block, kept in Arrow: only those of the best rows become Python strings."""

    def __init__(self, column: pa.Array, rows: np.ndarray | None = None):
        self.column, self.rows = column, rows

    def reordered(self, rows: np.ndarray) -> Words:
        return Words(self.column, rows if self.rows is None else self.rows[rows])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        rows = rows if self.rows is None else self.rows[rows]
        return np.array(self.column.take(pa.array(rows)).to_pylist(), dtype=object)


class Block:
    """Rows of the word table, in ascending order of index."""

    def __init__(self, index: np.ndarray, words: Words, vectors: np.ndarray):
        if np.any(index[1:] < index[:-1]):
            order = np.argsort(index, kind="stable")
            index, words, vectors = index[order], words.reordered(order), vectors[order]
        self.index, self.words, self.vectors = index, words, vectors
        self.norms = lengths(vectors)
        self.longest = self.norms.max(initial=0.0)
        self.shortest = self.norms.min(initial=np.inf)
        self.ordinary = ordinary(self.norms)
        self._directions: np.ndarray | None = None
        self._bands: list[Block] | None = None
        self._distinct: dict[int, Block] = {}
        self._factors: dict[str, np.ndarray] = {}

    def factor(self, metric: str) -> np.ndarray:
        """The rows as the factor of a matrix product that grows as rows get better under the metric."""
        if metric not in self._factors:
            if metric in DISTANCES:
                factor = np.c_[self.vectors, -0.5 * self.norms**2]
            elif metric == "cosine":
                factor = self.vectors / np.where(self.norms > 0, self.norms, np.nan)[:, None]
            else:
                factor = self.vectors
            self._factors[metric] = np.ascontiguousarray(factor.T)
        return self._factors[metric]

    def directions(self) -> np.ndarray:
        """The rows' directions as the right factor of a product."""
        if self._directions is None:
            self._directions = np.ascontiguousarray(directions(self.vectors, self.norms).T)
        return self._directions

    def bands(self) -> list[Block]:
        """The block cut into blocks of near lengths; rows without length are apart from others."""
        if self._bands is None:
            order = np.argsort(self.norms, kind="stable")
            empty = int(np.count_nonzero(self.norms == 0))
            parts = [p for side in (order[:empty], order[empty:]) for p in np.array_split(side, -(-len(side) // BAND_ROWS) or 1)]
            self._bands = [self.take(np.sort(part)) for part in parts if len(part)]
        return self._bands

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.index[rows], self.words.reordered(rows), self.vectors[rows])

    def without_surplus_copies(self, n: int) -> Block:
        """The block less the copies of a vector beyond the ``n`` of lowest index: those can never be among the best ``n``."""
        if n not in self._distinct:
            bits = np.ascontiguousarray(self.vectors + 0.0).view(np.dtype((np.void, self.vectors.shape[1] * 8))).ravel()
            _, copy_of = np.unique(bits, return_inverse=True)
            kept = np.flatnonzero(rank_in_group(copy_of, np.arange(len(copy_of))) < n)
            self._distinct[n] = self.take(kept) if len(kept) < len(copy_of) else self
        return self._distinct[n]


def rank_in_group(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Position from 0 of each element inside its group, ordered by the keys, first key first."""
    order = np.lexsort(tuple(reversed(keys)) + (group,))
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[starts, len(ordered)])
    rank = np.empty(len(group), dtype=np.int64)
    rank[order] = np.arange(len(group)) - np.repeat(starts, counts)
    return rank


def places_set(flags: np.ndarray) -> np.ndarray:
    """Flat positions of the true elements, looking at eight at a time as nearly all are false."""
    flags = flags.ravel()
    whole = len(flags) - len(flags) % 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64))
    which, offset = np.nonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.r_[eights[which] * 8 + offset, whole + np.flatnonzero(flags[whole:])]


class Best:
    """The best ``n`` rows seen so far for each query, under one metric. Keys are ordered so that lower is better.

    ``worst``, when given, is the score of a row that each query already has in its last place elsewhere, infinite or
    NaN where there is none: rows behind it are not taken in.
    """

    def __init__(self, queries: np.ndarray, n: int, metric: str, worst: np.ndarray | None = None):
        if metric not in LOWER_IS_BETTER:
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.n, self.queries = metric, n, queries
        self.is_distance = metric in DISTANCES
        self.norms = lengths(queries)
        # A zero vector has no angle, a query with an element that is no finite number no score: never ranked.
        finite = finite_rows(queries)
        self.ranked = finite if self.is_distance else finite & (self.norms > 0)
        self.ordinary = ordinary(self.norms[finite])
        self.limit = np.full(len(queries), np.inf)
        if worst is not None:
            self.limit = np.where(np.isfinite(worst), worst if self.is_distance else -worst, np.inf)
        self.key = np.full((len(queries), n), np.inf)
        self.index = np.full((len(queries), n), NO_INDEX, dtype=np.int64)
        # Where the rows held come from: words are fetched for the results alone.
        self.sources: list[Words] = []
        self.source = np.zeros((len(queries), n), dtype=np.int32)
        self.row = np.zeros((len(queries), n), dtype=np.int64)
        self._factor: np.ndarray | None = None

    def directions(self) -> np.ndarray:
        """The queries' directions as the left factor of a product, zero for those that are never ranked."""
        finite = finite_rows(self.queries)[:, None]
        return directions(np.where(finite, self.queries, 0.0), np.where(finite[:, 0], self.norms, 0.0))

    def factor(self) -> np.ndarray:
        """The queries as the left factor of a product in full precision; comparisons with NaN are false."""
        if self._factor is None:
            if self.is_distance:
                self._factor = np.c_[self.queries, np.ones(len(self.queries))]
            else:
                self._factor = self.queries / np.where(self.norms > 0, self.norms, np.nan)[:, None]
            self._factor[~self.ranked] = np.nan
        return self._factor

    def _margin(self, block: Block, chosen: np.ndarray) -> np.ndarray:
        """More than the rounding error of a product."""
        scale = 16.0 * (block.vectors.shape[1] + 8) * np.finfo(np.float64).eps
        if self.is_distance:
            return scale * (block.longest + self.norms[chosen]) ** 2
        return np.full(len(self.norms[chosen]), scale * (1.0 if self.metric == "cosine" else max(block.longest, 1.0)))

    def _least(self, chosen: np.ndarray) -> np.ndarray:
        """The product that the worst row held would have, minus infinity while places are free."""
        worst = np.minimum(self.key[chosen, -1], self.limit[chosen])
        if not self.is_distance:
            return -worst
        return 0.5 * (self.norms[chosen] ** 2 - (worst * worst if self.metric == "euclidean" else worst))

    def _cosine_needed(self, block: Block, chosen: np.ndarray, least: np.ndarray) -> np.ndarray:
        """A cosine below which no row of the block has a product of ``least``; 2 where there is none at all."""
        low, high = block.shortest, block.longest
        if self.metric == "cosine":
            needed = least if high > 0 else np.full(len(least), np.inf)
        elif self.is_distance:
            # The length at which a cosine goes furthest; without any length the cosine does not matter.
            norms, length = self.norms[chosen], np.clip(np.sqrt(2.0 * np.maximum(least, 0.0)), low, high)
            flat = np.where(-0.5 * low**2 >= least, -np.inf, np.inf)
            scale = norms * length
            needed = np.where(scale > 0, (least + 0.5 * length**2) / np.where(scale > 0, scale, 1.0), flat)
        elif high > 0:
            needed = np.minimum(least / low, least / high)
        else:
            needed = np.where(least <= 0, -np.inf, np.inf)
        return np.where(self.ranked[chosen], np.clip(needed, -2.0, 2.0), 2.0)

    def _held_at_least(self, block: Block, chosen: np.ndarray, rough: np.ndarray, error: float) -> np.ndarray:
        """A product that at least ``n`` rows of the block have for each query, near the ``n``-th largest.

        The row of the largest cosine is taken of each of many groups of rows.
        """
        groups = min(rough.shape[1], 32 * self.n)
        width = rough.shape[1] // groups
        most = rough[:, : groups * width].reshape(len(rough), groups, width).argmax(axis=2) + np.arange(groups) * width
        held = np.take_along_axis(rough, most, axis=1).astype(np.float64) - error
        if self.is_distance:
            held = self.norms[chosen][:, None] * block.norms[most] * held - 0.5 * block.norms[most] ** 2
        elif self.metric != "cosine":
            held *= block.norms[most]
        return np.partition(held, -self.n, axis=1)[:, -self.n]

    def add_near(self, block: Block, chosen: np.ndarray, rough: np.ndarray, top: np.ndarray) -> np.ndarray | None:
        """Take in a block of near lengths by rough cosines, ``top`` being the largest of each query.

        What it returns, if anything, are queries for which the block holds so many equal rows that surplus copies should
        be dropped first.
        """
        error, margin = rough_error(block.vectors.shape[1]), self._margin(block, chosen)
        least = self._least(chosen) - margin
        needed = self._cosine_needed(block, chosen, least) - error
        near = np.flatnonzero(top >= needed)
        if not len(near):
            return None
        if len(near) < len(chosen):
            chosen, rough, least, needed, margin = chosen[near], rough[near], least[near], needed[near], margin[near]
        candidates = rough >= needed.astype(np.float32)[:, None]
        count, enough = np.count_nonzero(candidates), 4 * self.n * len(rough) + 1024
        if count > enough and rough.shape[1] > self.n:
            floor = self._held_at_least(block, chosen, rough, error) - 2 * margin
            least = np.maximum(least, floor)
            needed = self._cosine_needed(block, chosen, least) - error
            candidates &= rough >= needed.astype(np.float32)[:, None]
            if np.count_nonzero(candidates) > enough and block.without_surplus_copies(self.n) is not block:
                return chosen
        query, row = np.divmod(places_set(candidates), rough.shape[1])
        if self.is_distance and len(query) and block.shortest < block.longest:
            most = self.norms[chosen][query] * block.norms[row] * (rough[query, row].astype(np.float64) + error) - 0.5 * block.norms[row] ** 2
            reached = most >= least[query]
            query, row = query[reached], row[reached]
        if len(query):
            self._merge(chosen[query], row, block)
        return None

    def add(self, block: Block, chosen: np.ndarray) -> bool:
        """Take in a block. False when it holds so many equal rows that surplus copies should be dropped first."""
        products = self.factor()[chosen] @ block.factor(self.metric)
        margin = self._margin(block, chosen)
        candidates = products >= (self._least(chosen) - margin)[:, None]
        enough = 4 * self.n * len(products) + 1024
        if np.count_nonzero(candidates) > enough and products.shape[1] > self.n:
            # NaN sorts last and would pass for the best.
            ordered = np.partition(np.nan_to_num(products, nan=-np.inf), -self.n, axis=1)
            candidates &= products >= (ordered[:, -self.n] - margin)[:, None]
            if np.count_nonzero(candidates) > enough and block.without_surplus_copies(self.n) is not block:
                return False
        query, row = np.divmod(places_set(candidates), products.shape[1])
        if len(query):
            self._merge(chosen[query], row, block)
        return True

    def _exact_keys(self, queries: np.ndarray, rows: np.ndarray, block: Block) -> np.ndarray:
        keys = np.empty(len(rows))
        step = max(1, EXACT_CELLS // max(1, block.vectors.shape[1]))
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            q, r = queries[part], rows[part]
            x, y = self.queries[q], block.vectors[r]
            if self.is_distance:
                squares = ((x - y) ** 2).sum(axis=1)
                keys[part] = np.sqrt(squares) if self.metric == "euclidean" else squares
            elif self.metric == "cosine":
                keys[part] = -((x * y).sum(axis=1) / (self.norms[q] * block.norms[r]))
            else:
                keys[part] = -((x / self.norms[q][:, None]) * y).sum(axis=1)
        return keys

    def _merge(self, query: np.ndarray, row: np.ndarray, block: Block) -> None:
        key = self._exact_keys(query, row, block)
        index = block.index[row]
        within = key <= self.limit[query]
        query, row, key, index = query[within], row[within], key[within], index[within]
        kept = rank_in_group(query, key, index) < self.n
        query, row, key, index = query[kept], row[kept], key[kept], index[kept]
        touched = np.unique(query)
        held = self.index[touched] != NO_INDEX
        all_query = np.r_[np.repeat(touched, self.n)[held.ravel()], query]
        all_key = np.r_[self.key[touched][held], key]
        all_index = np.r_[self.index[touched][held], index]
        if not self.sources or self.sources[-1] is not block.words:
            self.sources.append(block.words)
        all_source = np.r_[self.source[touched][held], np.full(len(row), len(self.sources) - 1, dtype=np.int32)]
        all_row = np.r_[self.row[touched][held], row]
        rank = rank_in_group(all_query, all_key, all_index)
        best = rank < self.n
        self.key[all_query[best], rank[best]] = all_key[best]
        self.index[all_query[best], rank[best]] = all_index[best]
        self.source[all_query[best], rank[best]] = all_source[best]
        self.row[all_query[best], rank[best]] = all_row[best]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query position, rank from 1, index, word and score of every row held."""
        query, slot = np.nonzero(self.index != NO_INDEX)
        key = self.key[query, slot]
        score = key if self.is_distance else -key
        source, row = self.source[query, slot], self.row[query, slot]
        words = np.full(len(query), None, dtype=object)
        for places in np.split(order := np.argsort(source, kind="stable"), np.flatnonzero(np.diff(source[order])) + 1):
            if len(places):
                words[places] = self.sources[source[places[0]]][row[places]]
        return query, slot + 1, self.index[query, slot], words, score


def scan_block(bests: list[Best], block: Block, asked: np.ndarray, chosen: np.ndarray | None = None) -> None:
    """Score one block of rows for every query, or for the chosen ones; ``asked`` holds the directions of all queries."""
    if not len(block.index):
        return
    chosen = np.arange(len(asked)) if chosen is None else chosen
    if not (block.ordinary and all(best.ordinary for best in bests)):
        _scan_exactly(bests, block, chosen)
        return
    for band in block.bands():
        step = max(1, ROUGH_CELLS // len(band.index))
        for start in range(0, len(chosen), step):
            some = chosen[start : start + step]
            rough = asked[some] @ band.directions()
            top = rough.max(axis=1)
            for best in bests:
                crowded = best.add_near(band, some, rough, top)
                if crowded is not None:
                    fewer = band.without_surplus_copies(best.n)
                    again = asked[crowded] @ fewer.directions()
                    best.add_near(fewer, crowded, again, again.max(axis=1))


def _scan_exactly(bests: list[Best], block: Block, chosen: np.ndarray) -> None:
    """As ``scan_block`` with products in full precision, for lengths near the ends of the number range."""
    step = max(1, BLOCK_CELLS // len(block.index))
    for best in bests:
        for start in range(0, len(chosen), step):
            some = chosen[start : start + step]
            if not best.add(block, some):
                best.add(block.without_surplus_copies(best.n), some)


def nearest_centre(vectors: np.ndarray, centres: np.ndarray, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest centre of each row and the squared distance to it; the first centre wins a tie.

    ``rest``, when given, is filled with a lower bound of the squared distance to every other centre.
    """
    rows = len(vectors)
    nearest = np.zeros(rows, dtype=np.int64)
    squared = np.zeros(rows)
    centre_norms, row_norms = lengths(centres), lengths(vectors)
    scale = 16.0 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps
    step = max(1, BLOCK_CELLS // max(1, len(centres)))
    for start in range(0, rows, step):
        part = slice(start, min(start + step, rows))
        x = vectors[part]
        rough = centre_norms[None, :] ** 2 - 2.0 * (x @ centres.T)
        choice = rough.argmin(axis=1)
        margin = scale * (row_norms[part] + centre_norms.max()) ** 2
        close = rough <= (rough[np.arange(len(x)), choice] + margin)[:, None]
        exact = ((x - centres[choice]) ** 2).sum(axis=1)
        # Rows with several centres inside the rounding margin are decided by the exact distance.
        row, option = np.nonzero(close & (close.sum(axis=1) > 1)[:, None])
        distance = np.empty(len(row))
        pairs = max(1, EXACT_CELLS // max(1, vectors.shape[1]))
        for first in range(0, len(row), pairs):
            some = slice(first, first + pairs)
            distance[some] = ((x[row[some]] - centres[option[some]]) ** 2).sum(axis=1)
        first = rank_in_group(row, distance, option) == 0
        choice[row[first]], exact[row[first]] = option[first], distance[first]
        nearest[part], squared[part] = choice, exact
        if rest is not None:
            rough[np.arange(len(x)), choice] = np.inf
            rest[part] = np.maximum(rough.min(axis=1) + row_norms[part] ** 2 - margin, 0.0)
    return nearest, squared
