"""Near-duplicate vectors: p-stable projections put unit vectors into buckets of several tables, cosines decide."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled, small_or_settled
from wordloom.llm.components import components

COSINE = 0.9
# Width of a projection's cells, in the unit of the vectors' length, and the share of links at exactly the threshold
# that may be missed by all tables; closer ones are missed far more rarely.
WIDTH = 2.0
MISSED = 0.005
# Vectors that one task compares with one another; larger buckets are cut into pairs of such blocks.
BLOCK = 1024
SEED = 17
# Largest group compared together with others, and tables in which a pair's earlier meetings are looked for at a time.
SMALL = 64
TABLES_AT_ONCE = 16
# Tables whose buckets of at least so many vectors are looked at for balls of vectors that all link.
LEAD_TABLES = 8
CROWDED = 64


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that one p-stable projection puts two points of this Euclidean distance into one cell."""
    t = width / distance
    normal = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_plan(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors.

    Unrelated unit vectors are sqrt(2) apart: projections are added until one vector in ten meets such another one in a
    bucket; tables are added until a pair at the threshold meets in one of them but for ``missed``.
    """
    far, near = same_cell(math.sqrt(2)), same_cell(math.sqrt(2 - 2 * cosine))
    each = math.ceil(math.log(10 * max(n, 10)) / -math.log(far))
    return each, math.ceil(math.log(missed) / math.log(1 - near**each))


@functools.cache
def _projections(size: int, each: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, shifts and hash factors, by table."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((size, each * tables))
    shifts = rng.uniform(0, WIDTH, each * tables)
    factors = rng.integers(1, 2**63, each * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lines, shifts, factors


def bucket_keys(unit: np.ndarray, each: int, tables: int, seed: int = SEED, first: int = 0, last: int | None = None) -> np.ndarray:
    """The bucket of every vector in every table, or in those from ``first`` to ``last``: its cells hashed to 64 bits."""
    lines, shifts, factors = _projections(unit.shape[1], each, tables, seed)
    part = slice(first * each, (tables if last is None else last) * each)
    cells = np.floor((unit @ lines[:, part] + shifts[part]) / WIDTH).astype(np.int64).view(np.uint64)
    keys = (cells * factors[part]).reshape(len(unit), -1, each).sum(axis=2, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1 without overflow."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that can have links: not absent, not zero, all components finite numbers."""
    number = F.expr("""embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))
        and exists(embedding, x -> x <> 0)""")
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & number)


def links(points: DataFrame, cosine: float = COSINE, missed: float = MISSED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (``rep, copies, embedding``): ``rep, partners``, the rows at a cosine of at least ``cosine``
    without own copies, and edges ``a, b`` that connect what is linked.

    Vectors of a crowded bucket that all link (``_balls``) are counted and connected without comparing them. The others of
    a bucket are compared by matrix products, in pairs of blocks when there are many. A pair counts in the first table where both share a bucket, so partners are counted once without a list of pairs; sums per vector and a
    spanning forest per pair of blocks are all that leaves a task. Vectors of different lengths are never compared.
    """
    each, tables = table_plan(points.count(), cosine, missed)

    def buckets(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for a in range(0, part.num_rows, 256):
                    some = part.slice(a, 256)
                    keys = bucket_keys(unit_rows(some.column("embedding")), each, tables)
                    # Vectors of different lengths are apart: the length goes into the key.
                    keys = keys ^ np.int64(int(size) * 0x1F123BB5159A55E5 % 2**63)
                    numbers = np.tile(np.arange(tables, dtype=np.int32), len(keys))
                    reps = np.repeat(some.column("rep").to_numpy(), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(numbers), pa.array(keys.ravel())], ["rep", "at", "key"])

    # Buckets are dealt as narrow rows, by ranges that cut a crowded one; a vector goes only where another one is.
    narrow = settled(points.select("rep", "embedding").mapInArrow(buckets, "rep bigint, at int, key bigint"))
    dealt = narrow.repartitionByRange("key", "at", "rep").sortWithinPartitions("key", "at", "rep")
    near = settled(dealt.mapInArrow(_repeated, narrow.schema))
    balls = settled(_balls(points, near, cosine))
    labelled = near.join(small_or_settled(balls.select("rep", "ball")), "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    labelled = settled(labelled)
    held = labelled.groupBy("at", "key", "ball").agg(F.count(F.lit(1)).alias("c"))
    held = held.groupBy("at", "key").agg(F.sum("c").alias("held"), F.max(F.struct("c", "ball")).alias("most")).filter("held > most.c")
    # Blocks of the largest ball of a crowded bucket, which are not compared with one another, come before all others.
    pure = F.when(F.col("most.c") > block, F.ceil(F.col("most.c") / block)).otherwise(0).cast("int")
    other = F.ceil((F.col("held") - F.when(F.col("most.c") > block, F.col("most.c")).otherwise(0)) / block).cast("int")
    held = held.select("at", "key", F.col("most.ball").alias("first"), pure.alias("pure"), other.alias("other"))
    inside = (F.col("pure") > 0) & (F.col("ball") == F.col("first"))
    number = F.xxhash64("rep")
    own = F.when(inside, F.pmod(number, F.greatest("pure", F.lit(1)))).otherwise(F.col("pure") + F.pmod(number, F.col("other"))).cast("int")
    met = labelled.join(held, ["at", "key"]).withColumn("own", own)
    against = F.sequence(F.when(inside, F.col("pure")).otherwise(0), F.col("pure") + F.col("other") - 1)
    pairs = F.transform(against, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    met = met.withColumn("p", F.explode(pairs)).select("rep", "ball", "at", "key", "own", "p.i", "p.j")
    group = ["at", "key", "i", "j"]
    rows = met.join(points, "rep").select(*group, "own", "ball", "rep", "copies", "embedding")
    dealt = rows.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            marks = [table.column(c).to_numpy() for c in group]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in marks])
            starts = np.flatnonzero(new)
            # The last group may go on in the next batch.
            if len(starts) > 1:
                yield _compared(table.slice(0, starts[-1]), starts, cosine, each, tables)
            held = table.slice(starts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield _compared(held, np.array([0, held.num_rows]), cosine, each, tables)

    found = settled(dealt.mapInArrow(compare, "rep bigint, partners bigint, other bigint"))
    # Members of a ball link with one another, whatever buckets they share.
    sizes = balls.groupBy("ball").agg(F.sum("copies").alias("all"))
    together = balls.join(sizes, "ball").select("rep", (F.col("all") - F.col("copies")).alias("partners"))
    partners = found.filter("other is null").select("rep", "partners").unionByName(together).groupBy("rep").agg(F.sum("partners").alias("partners"))
    edges = found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    return partners, edges.unionByName(balls.filter("rep <> ball").select(F.col("rep").alias("a"), F.col("ball").alias("b")))


def _repeated(batches):
    """The rows, sorted by bucket, of buckets with more than one; the ends of a partition stay, as its neighbours may hold more."""
    last, stays = None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
        same = (key[1:] == key[:-1]) & (at[1:] == at[:-1])
        keep = np.zeros(n, bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is None:
            keep[0] = True
        else:
            goes_on = last.column("key")[0].as_py() == key[0] and last.column("at")[0].as_py() == at[0]
            keep[0] |= goes_on
            if stays or goes_on:
                yield last
        yield batch.slice(0, n - 1).filter(pa.array(keep[:-1]))
        last, stays = batch.slice(n - 1), keep[-1]
    if last is not None:
        yield last


def _balls(points: DataFrame, near: DataFrame, cosine: float) -> DataFrame:
    """``rep, ball, copies``: vectors of crowded buckets within half the threshold's angle of a bucket's smallest one.

    Two such vectors are within the threshold's angle of one another, so all of a ball link and need no comparison. Only
    the first tables are looked at; a vector in several balls counts in the one of the smallest leader. A crowded place
    that one ball does not cover is compared as any other.
    """
    first = near.filter(F.col("at") < LEAD_TABLES)
    crowded = first.groupBy("at", "key").agg(F.count(F.lit(1)).alias("held"), F.min("rep").alias("leader")).filter(F.col("held") >= CROWDED)
    led = first.join(small_or_settled(crowded.select("at", "key", "leader")), ["at", "key"]).select("rep", "leader").distinct()
    scaled = F.expr("transform(array(array_max(transform(embedding, x -> abs(double(x))))), m -> transform(embedding, x -> double(x) / m))[0]")
    members = led.join(points, "rep").select("rep", "copies", "leader", scaled.alias("x"))
    heads = points.select(F.col("rep").alias("leader"), scaled.alias("y")).join(led.select("leader").distinct(), "leader", "left_semi")
    both = members.join(small_or_settled(heads), "leader").filter(F.size("x") == F.size("y"))
    dot = "aggregate(zip_with({0}, {1}, (a, b) -> a * b), 0D, (t, p) -> t + p)"
    angle = F.expr(f"{dot.format('x', 'y')} / sqrt({dot.format('x', 'x')} * {dot.format('y', 'y')})")
    # Far more than rounding can change.
    half = math.cos(math.acos(max(min(cosine, 1.0), -1.0)) / 2) + 1e-9
    return both.filter(angle >= half).groupBy("rep").agg(F.min("leader").alias("ball"), F.first("copies").alias("copies"))


def _pairs_within(unit: np.ndarray, ends: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of many small groups: every row with the next one of its group, then the one after it, and so on."""
    at, step, found = np.arange(len(unit)), 1, []
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        linked = at[np.einsum("ij,ij->i", unit[at], unit[at + step]) >= cosine]
        found.append(np.stack([linked, linked + step]))
        step += 1
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _met_first_here(unit: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, each: int, tables: int) -> np.ndarray:
    """Which pairs share no bucket in a table before their own. Tables are looked at some at a time, as few pairs last."""
    left = np.arange(len(x))
    for first in range(0, tables, TABLES_AT_ONCE):
        going = left[at[left] > first]
        if not len(going):
            break
        last = min(first + TABLES_AT_ONCE, tables)
        met = np.zeros(len(x), bool)
        for a in range(0, len(going), 4096):
            some = going[a : a + 4096]
            rows, place = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
            keys = bucket_keys(unit[rows], each, tables, SEED, first, last)
            same = keys[place[: len(some)]] == keys[place[len(some) :]]
            met[some] = (same & (np.arange(first, last) < at[some][:, None])).any(axis=1)
        left = left[~met[left]]
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


def _compared(rows: pa.Table, starts: np.ndarray, cosine: float, each: int, tables: int) -> pa.RecordBatch:
    """Partners that count in these whole groups per vector (``other`` absent), and a spanning forest of their links.

    ``starts`` ends with the number of rows. Vectors of a group have one length; batches may hold several lengths.
    """
    rows = rows.combine_chunks()
    at, i, j, own, ball, reps, copies = (rows.column(c).to_numpy() for c in ("at", "i", "j", "own", "ball", "rep", "copies"))
    vectors = rows.column("embedding").chunk(0)
    widths = np.diff(vectors.offsets.to_numpy())
    sizes, partners, forests = np.diff(starts), np.zeros(rows.num_rows, np.int64), []
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        unit = unit_rows(vectors.take(pa.array(here)))
        group = group_of[here]
        few = (sizes[group] <= SMALL) & (i[here] == j[here])
        little = np.flatnonzero(few)
        ends = np.searchsorted(group[little], group[little], "right")
        x, y = _pairs_within(unit[little], ends, cosine)
        found = [np.stack([little[x], little[y]])]
        for g in np.unique(group[~few]):
            members = np.flatnonzero(group == g)
            start = here[members[0]]
            left = members[own[here[members]] == i[start]]
            right = left if i[start] == j[start] else members[own[here[members]] == j[start]]
            x, y = np.nonzero(unit[left] @ unit[right].T >= cosine)
            x, y = left[x], right[y]
            found.append(np.stack([x, y])[:, x < y] if i[start] == j[start] else np.stack([x, y]))
        x, y = np.concatenate(found, axis=1)
        apart = ball[here[x]] != ball[here[y]]
        x, y = x[apart], y[apart]
        new = _met_first_here(unit, x, y, at[here[x]], each, tables)
        x, y = here[x[new]], here[y[new]]
        partners += np.bincount(x, copies[y], rows.num_rows).astype(np.int64) + np.bincount(y, copies[x], rows.num_rows).astype(np.int64)
        forests.append(np.stack(forest(x, y, rows.num_rows)))
    some = np.flatnonzero(partners)
    a, b = np.concatenate(forests, axis=1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([reps[some], reps[a]]), pa.int64()),
            pa.array(np.concatenate([partners[some], np.zeros(len(a), np.int64)])),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(reps[b], pa.int64())]),
        ],
        ["rep", "partners", "other"],
    )


def forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links x - y that connect all that they connect, without a circle.

    In each round every tree with a link to a tree of a smaller number joins one of these.
    """
    label, out = np.arange(n), []
    while True:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            chosen = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            return chosen[:, 0], chosen[:, 1]
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        trees, pick = np.unique(high, return_index=True)
        out.append(np.stack([x[pick], y[pick]], axis=1))
        parent = np.arange(n)
        parent[trees] = low[pick]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Vectors link at a cosine of at least ``cosine`` in double precision; none below is linked. Pairs at exactly the
    threshold are found but for a share of ``missed``, closer ones more surely. Equal vectors are one point, so copies
    are linked without being compared; a vector's links count all rows of its partners and its own copies.

    Vectors that are absent, zero, or hold absent or non-finite components link with nothing, nor do rows without a
    vec_id; they are their own component. Repeated rows are copies of one another. An empty table gives no rows;
    columns of other names are not read.
    """
    plain = usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
    points = settled(plain.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    partners, edges = links(points, cosine, missed, block)
    found = components(edges)
    named = points.join(partners, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    named = named.select(
        F.col("embedding").alias("_point"),
        (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # A zero of either sign is one value, as in the grouping; rows that cannot link match no point.
    rows = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("_own"))
    joined = rows.join(named, F.col("_own") == F.col("_point"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
