"""Descriptive statistics of scalar groups, vector dimensions and vector lengths.

Exact percentiles are found without sorting a whole group in one task. A quantile sketch, gathered in the same pass as
size and moments, brackets each wanted rank by two values; a second pass counts exactly what lies below, between and
inside the brackets and sorts only the values inside. A bracket that is still crowded is narrowed by counts over
equal-width bins first, which is also how vector dimensions, counted inside the tasks, are narrowed. Equal values are
counted before the shuffle, so a value that fills a third of a group costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.bounds import gathered, join_groups, settled
from wordloom.functions.vectors import vec_norm
from wordloom.operators import dimension_kernels as kernels

# The percentiles of a summary.
PERCENTILES = (2, 9, 25, 50, 75, 91, 98)

# Size of a sketch, the share of a group by which a bracket reaches beyond its rank on both sides (several times the error
# to expect of the sketch), and rows of a group that are sorted without brackets, as one row is more than that share.
# A rank that its bracket misses is seen by the exact counts and found by refinement, so they set the speed alone.
SKETCH_SIZE = 1024
BRACKET_SHARE = 0.01
UNBRACKETED_ROWS = 4096

# Bins per refinement step.
REFINE_BINS = 1024
# Values of one range that a single task may sort, and values that are sorted in all before ranges are split for speed.
CROWDED_ROWS = 1_000_000
SORT_ROWS = 250_000
# Ranges that are split to save sorting must hold this many values per bin, or counting them would cost as much.
VALUES_PER_BIN = 32

_ONE = "_one_group"


class _Scalars:
    """Values in rows: ``keys..., _v``."""

    def __init__(self, df: DataFrame, group: Sequence[str], value: str | Column):
        """Missing values are left out; a constant key stands in when there is no group."""
        value = (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")
        self.keys = list(group) or [_ONE]
        self.rows = df.select(*(group or [F.lit(1).alias(_ONE)]), value).filter("_v is not null")

    def sizes(self, shares: Sequence[float] = ()) -> DataFrame:
        v = F.col("_v")
        found = self.rows.groupBy(*self.keys).agg(
            F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), *_sketched(v, shares)
        )
        return _bracketed(found, shares)

    def moments(self, shares: Sequence[float] = ()) -> DataFrame:
        """Size, extremes, mean and sample spread of each group; a single value has no spread."""
        v = F.col("_v")
        found = self.rows.groupBy(*self.keys).agg(
            F.count(v).alias("n"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
            *_sketched(v, shares),
        )
        return _bracketed(found, shares)

    def in_brackets(self, groups: DataFrame, most: int) -> DataFrame:
        """``keys..., part, _v, copies``: values inside the brackets one by one, those elsewhere as one count per gap.

        The parts of a group ascend: part 0 lies below the first bracket, 1 is that bracket, 2 lies above it, and so on.
        A group has at most ``most`` brackets.
        """
        placed = join_groups(self.rows, groups.select(*self.keys, "_brackets"), self.keys)
        reached = [F.coalesce((F.get("_brackets", F.lit(i))["low"] <= F.col("_v")).cast("int"), F.lit(0)) for i in range(most)]
        begun = reduce(lambda a, b: a + b, reached)
        inside = F.coalesce(F.col("_v") <= F.get("_brackets", begun - 1)["high"], F.lit(False))
        part = (2 * begun - inside.cast("int")).alias("part")
        value = F.when(inside, F.col("_v")).alias("_v")
        return placed.groupBy(*self.keys, part, value).agg(F.count(F.lit(1)).alias("copies"))

    def bins_of(self, ranges: DataFrame, known: pa.Table | None) -> DataFrame:
        """``keys..., base, bin, low, high, held`` for ranges ``keys..., from, to, base``."""
        inside = join_groups(self.rows, ranges, self.keys).filter(F.col("_v").between(F.col("from"), F.col("to")))
        place = _refining_bin(F.col("_v"), F.col("from"), F.col("to"))
        return inside.groupBy(*self.keys, "base", place.alias("bin")).agg(
            F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("held")
        )

    def values_in(self, ranges: DataFrame, known: pa.Table | None) -> DataFrame:
        """``keys..., below, _v, copies``: the distinct values in the ranges ``keys..., low, high, below``."""
        inside = join_groups(self.rows, ranges, self.keys).filter(F.col("_v").between(F.col("low"), F.col("high")))
        return inside.groupBy(*self.keys, "below", "_v").agg(F.count(F.lit(1)).alias("copies"))

    def bin_counts(self, ends: DataFrame, known: pa.Table | None, bins: int) -> DataFrame:
        """``keys..., bin, count`` for equal-width bins between ``min`` and ``max``."""
        place = _bin(F.col("_v"), F.col("min"), F.col("max"), bins)
        placed = join_groups(self.rows, ends.select(*self.keys, "min", "max"), self.keys)
        return placed.groupBy(*self.keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


class _Dimensions(_Scalars):
    """The elements of a vector column by model and dimension, from rows ``model, vector``. Tasks count their own elements
    as long as the tables of ranges are small enough to copy to them; otherwise the elements become rows."""

    def __init__(self, df: DataFrame):
        self.vectors = df.select("model", "vector").filter("vector is not null")
        elements = self.vectors.select("model", F.posexplode("vector").alias("dimension", "value"))
        super().__init__(elements, ["model", "dimension"], "value")

    def sizes(self, shares: Sequence[float] = ()) -> DataFrame:
        return self.moments().select(*self.keys, "n", "min", "max")

    def moments(self, shares: Sequence[float] = ()) -> DataFrame:
        """As for rows, without brackets: the tasks count elements themselves."""
        parts = self.vectors.mapInArrow(
            kernels.moments, "model string, dimension int, size int, n long, mean double, squares double, min double, max double"
        )
        own = Window.partitionBy("model", "dimension")
        grand = F.sum(F.col("mean") * F.col("n")).over(own) / F.sum("n").over(own)
        parts = parts.withColumn("grand", grand)
        ragged = F.min("size") != F.max("size")
        spread = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2))
        return parts.groupBy("model", "dimension").agg(
            F.when(ragged, F.raise_error(F.lit("vector sizes differ"))).otherwise(F.sum("n")).cast("long").alias("n"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.first("grand").alias("mean"),
            F.when(F.sum("n") > 1, spread / (F.sum("n") - 1)).otherwise(0.0).alias("variance"),
        )

    def bins_of(self, ranges: DataFrame, known: pa.Table | None) -> DataFrame:
        if known is None:
            return super().bins_of(ranges, known)
        counted = self.vectors.mapInArrow(
            kernels.refining_counts(kernels.ranges_by_model(known, "from", "to", "base"), REFINE_BINS),
            "model string, dimension int, base long, bin int, low double, high double, held long",
        )
        return counted.groupBy("model", "dimension", "base", "bin").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("held").alias("held")
        )

    def values_in(self, ranges: DataFrame, known: pa.Table | None) -> DataFrame:
        if known is None:
            return super().values_in(ranges, known)
        picked = self.vectors.mapInArrow(
            kernels.values_inside(kernels.ranges_by_model(known, "low", "high", "below")),
            "model string, dimension int, below long, _v double, copies long",
        )
        return picked.groupBy("model", "dimension", "below", "_v").agg(F.sum("copies").alias("copies"))

    def bin_counts(self, ends: DataFrame, known: pa.Table | None, bins: int) -> DataFrame:
        if known is None:
            return super().bin_counts(ends, known, bins)
        counted = self.vectors.mapInArrow(
            kernels.equal_width_counts(known, bins), "model string, dimension int, bin int, count long"
        )
        return counted.groupBy("model", "dimension", "bin").agg(F.sum("count").alias("count"))


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.drop(_ONE)


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value; the highest value belongs to the last bin, and to the first when all are equal."""
    width = (high - low) / bins
    return (
        F.when(value == low, 0)
        .when(value == high, bins - 1)
        .otherwise(F.least(F.floor(F.try_divide(value - low, width)), F.lit(bins - 1)))
        .cast("int")
    )


def _refining_bin(value: Column, low: Column, high: Column) -> Column:
    """As ``_bin``, safe for ranges so wide or so narrow that their width is not a usable number."""
    share = F.try_divide(value * 0.5 - low * 0.5, high * 0.5 - low * 0.5)
    share = F.greatest(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    inner = F.least(F.floor(share * REFINE_BINS), F.lit(REFINE_BINS - 2))
    return F.when(value >= high, REFINE_BINS - 1).otherwise(F.greatest(inner, F.lit(0))).cast("int")


Positions = Mapping[str, tuple[float, Column]]


def _sketched(value: Column, shares: Sequence[float]) -> list[Column]:
    return [F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias("_sketch")] if shares else []


def _bracketed(groups: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Adds ``_brackets``: ascending ranges of values, apart from one another, that should hold the ranks at the given shares."""
    if not shares:
        return groups
    whole = F.array(F.struct(F.col("min").alias("low"), F.col("max").alias("high")))

    def at(share: float) -> Column:
        if share <= 0.0 or share >= 1.0:
            return F.col("min" if share <= 0.0 else "max")
        return F.kll_sketch_get_quantile_double("_sketch", F.lit(share))

    ends = [F.struct(at(p - BRACKET_SHARE).alias("low"), at(p + BRACKET_SHARE).alias("high")) for p in sorted(set(shares))]
    # The brackets ascend at both ends, so one that meets the last one kept only moves its upper end.
    joined = F.expr("""aggregate(slice(_ends, 2, size(_ends)), slice(_ends, 1, 1), (kept, e) -> case
        when e.low <= element_at(kept, -1).high
        then concat(slice(kept, 1, size(kept) - 1), array(named_struct('low', element_at(kept, -1).low, 'high', e.high)))
        else concat(kept, array(e)) end)""")
    sketched = (F.col("n") > UNBRACKETED_ROWS) & (F.kll_sketch_get_n_double("_sketch") > 0)
    found = groups.withColumn("_ends", F.when(sketched, F.array(*ends)).otherwise(whole)).withColumn("_brackets", joined)
    return found.drop("_sketch", "_ends")


def _placed(groups: DataFrame, positions: Positions) -> tuple[DataFrame, pa.Table | None]:
    """The group table computed once, with the wanted positions and the ranks next to them as arrays.

    Positions count from 1 and are expressions of the group size ``n``; they are clamped to 1..n.
    """
    clamped = [F.when(at.isNotNull(), F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), at))) for _, at in positions.values()]
    placed = groups.withColumn("_at", F.array(*clamped))
    ends = F.flatten(F.transform(F.array_compact("_at"), lambda at: F.array(F.floor(at), F.ceil(at))))
    return gathered(placed.withColumn("_ranks", F.array_distinct(ends.cast("array<bigint>"))))


def _shares(positions: Positions) -> list[float]:
    return [share for share, _ in positions.values()]


def _values_at(
    source: _Scalars, groups: tuple[DataFrame, pa.Table | None], names: Sequence[str], crowded_rows: int
) -> DataFrame:
    """The value at each position of the sorted group, linear between neighbouring ranks; NULL for a NULL position.

    ``groups`` comes from ``_placed`` and holds ``n, min, max``. The result has one more column per position.
    """
    keys, (table, known) = source.keys, groups
    wanted = table.select(*keys, F.explode("_ranks").alias("rank"))
    values = None
    # So few values are sorted sooner than counted; the rows are the same either way.
    few = known is not None and (pc.sum(known.column("n")).as_py() or 0) <= min(crowded_rows, SORT_ROWS)
    if "_brackets" in table.columns and not few:
        values = _values_in_brackets(source, table, known, wanted, len(names), crowded_rows)
    if values is None:
        values = _values_by_refinement(source, table, known, wanted, crowded_rows)

    running = Window.partitionBy(*keys, "below").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = values.withColumn("last", F.col("below") + F.sum("copies").over(running))
    is_here = (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("copies"))
    found = join_groups(last, wanted, keys).filter(is_here)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("at_rank"))

    def interpolated(at: Column) -> Column:
        lower, upper = F.col("at_rank")[F.floor(at).cast("long")], F.col("at_rank")[F.ceil(at).cast("long")]
        return F.when(lower == upper, lower).otherwise(lower + (at - F.floor(at)) * (upper - lower))

    out = join_groups(by_rank, table, keys).withColumn("_found", F.transform("_at", interpolated))
    kept = [c for c in table.columns if c not in ("_at", "_ranks", "_brackets")]
    return out.select(*kept, *[F.col("_found")[i].alias(name) for i, name in enumerate(names)])


def _values_in_brackets(
    source: _Scalars, table: DataFrame, known: pa.Table | None, wanted: DataFrame, most: int, crowded_rows: int
) -> DataFrame | None:
    """``keys..., below, _v, copies`` from one pass over the rows, the counts being exact whatever the sketch said.

    A bracket of more than ``crowded_rows`` distinct values is narrowed further. None when a rank lies outside all
    brackets: then the sketch was unlucky.
    """
    keys = source.keys
    counted = settled(source.in_brackets(table, most))
    parts = counted.groupBy(*keys, "part").agg(
        F.sum("copies").alias("held"), F.count("_v").alias("distinct"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("held").over(before), F.lit(0)).cast("long")
    brackets = parts.withColumn("below", below).filter(F.col("part") % 2 == 1)
    if known is not None:
        # The groups are few enough to copy, and each has a few brackets.
        rows = brackets.toArrow()
        brackets = F.broadcast(table.sparkSession.createDataFrame(rows, brackets.schema))
        found = known.select([*keys, "_ranks"]).to_pandas().explode("_ranks").merge(rows.to_pandas(), on=keys, how="left")
        inside = (found["_ranks"] > found["below"]) & (found["_ranks"] <= found["below"] + found["held"])
        missed = int(pc.sum(pc.list_value_length(known.column("_ranks"))).as_py() or 0) - int(inside.sum())
        largest = found["distinct"].where(inside).max()
    holds_rank = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("held"))
    if known is None:
        brackets = settled(brackets)
        inside = join_groups(wanted, brackets, keys).filter(holds_rank)
        facts = inside.agg(F.count(F.lit(1)).alias("ranks"), F.max("distinct").alias("most")).head()
        missed, largest = wanted.count() - facts["ranks"], facts["most"] or 0
    if missed:
        return None
    if largest > crowded_rows:
        ranges = join_groups(wanted, brackets, keys).filter(holds_rank).select(*keys, "low", "high", "below", "held").distinct()
        return _refined(source, *gathered(ranges), wanted, crowded_rows)
    used = brackets.select(*keys, "part", "below")
    return join_groups(counted.filter(F.col("part") % 2 == 1), used, [*keys, "part"]).select(*keys, "below", "_v", "copies")


def _values_by_refinement(
    source: _Scalars, table: DataFrame, known: pa.Table | None, wanted: DataFrame, crowded_rows: int
) -> DataFrame:
    """``keys..., below, _v, copies`` for ranges narrowed from the extremes of each group."""
    keys = source.keys
    ranges = table.select(
        *keys, F.col("min").alias("low"), F.col("max").alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held")
    )
    if known is not None:
        below = pa.array([0] * known.num_rows, pa.int64())
        parts = [known.column(c) for c in (*keys, "min", "max")] + [below, known.column("n")]
        known = pa.table(parts, [*keys, "low", "high", "below", "held"])
    return _refined(source, ranges, known, wanted, crowded_rows)


def _refined(source: _Scalars, ranges: DataFrame, known: pa.Table | None, wanted: DataFrame, crowded_rows: int) -> DataFrame:
    """The values in ranges (``keys..., low, high, below, held``) that hold a wanted rank, crowded ones split first."""
    limit = _split_above(ranges, known, crowded_rows)
    while limit is not None:
        ranges, known = gathered(_split(source, ranges, known, wanted, limit))
        limit = _split_above(ranges, known, crowded_rows)
    return source.values_in(ranges, known)


def _split_above(ranges: DataFrame, known: pa.Table | None, crowded_rows: int) -> int | None:
    """The size above which ranges should be split before sorting them, or None when all can be sorted as they are.

    A range must not outgrow a task, and when the sorting as a whole is large, the ranges worth splitting are split.
    A range of one value is never split: its copies are counted, not sorted.
    """
    worth = min(crowded_rows, VALUES_PER_BIN * REFINE_BINS)
    if known is None:
        held = F.when(F.col("low") < F.col("high"), F.col("held")).otherwise(0)
        found = ranges.agg(F.max(held).alias("m"), F.sum(F.when(held > worth, held).otherwise(0)).alias("t")).head()
        largest, total = found["m"] or 0, found["t"] or 0
    else:
        counts, lows, highs = (known.column(c).to_numpy() for c in ("held", "low", "high"))
        sizes = counts[lows != highs]
        largest, total = int(sizes.max(initial=0)), int(sizes[sizes > worth].sum())
    if total > min(crowded_rows, SORT_ROWS):
        return worth
    return crowded_rows if largest > crowded_rows else None


def _split(source: _Scalars, ranges: DataFrame, known: pa.Table | None, wanted: DataFrame, limit: int) -> DataFrame:
    """Divide the ranges of more than ``limit`` values into bins and keep the bins that hold a wanted rank.

    A bin's new range is the span of the values really in it, so an outlier is shed in one step.
    """
    keys, columns = source.keys, [*source.keys, "low", "high", "below", "held"]
    is_crowded = (F.col("held") > limit) & (F.col("low") < F.col("high"))
    crowded = ranges.filter(is_crowded).select(
        *keys, F.col("low").alias("from"), F.col("high").alias("to"), F.col("below").alias("base")
    )
    if known is not None:
        known = known.filter((pc.field("held") > limit) & (pc.field("low") < pc.field("high")))
        known = known.select([*keys, "low", "high", "below"]).rename_columns([*keys, "from", "to", "base"])
    running = Window.partitionBy(*keys, "base").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = source.bins_of(crowded, known)
    placed = bins.withColumn("below", F.col("base") + F.sum("held").over(running) - F.col("held"))
    holds_rank = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("held"))
    kept = join_groups(placed, wanted, keys).filter(holds_rank).select(*columns).distinct()
    return ranges.filter(~is_crowded).select(*columns).unionByName(kept)


def point(percentile: float) -> str:
    """Column name of a percentile: ``p25``, ``p0_5``."""
    return f"p{percentile:g}".replace(".", "_")


def _percentile_positions(percentiles: Sequence[float]) -> dict[str, tuple[float, Column]]:
    return {point(p): (p / 100.0, (F.col("n") + 1) * float(p) / 100.0) for p in percentiles}


def exact_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str | Column,
    percentiles: Sequence[float] = PERCENTILES,
    crowded_rows: int = CROWDED_ROWS,
) -> DataFrame:
    """Percentiles at position ``p (n + 1) / 100``, linear between ranks, clamped to the extremes: ``group..., n, p2, ...``."""
    source, positions = _Scalars(df, group, value), _percentile_positions(percentiles)
    out = _values_at(source, _placed(source.sizes(_shares(positions)), positions), list(positions), crowded_rows)
    return _unkeyed(out.drop("min", "max"))


def summary(
    df: DataFrame,
    group: Sequence[str],
    value: str | Column,
    percentiles: Sequence[float] = PERCENTILES,
    crowded_rows: int = CROWDED_ROWS,
) -> DataFrame:
    """``group..., n, max, min, mean, stdev, variance`` and one column per percentile."""
    source, positions = _Scalars(df, group, value), _percentile_positions(percentiles)
    groups = _placed(source.moments(_shares(positions)), positions)
    return _unkeyed(_summary(source, groups, list(positions), crowded_rows))


def _summary(
    source: _Scalars, moments: tuple[DataFrame, pa.Table | None], points: Sequence[str], crowded_rows: int
) -> DataFrame:
    out = _values_at(source, moments, points, crowded_rows)
    return out.select(*source.keys, "n", "max", "min", "mean", F.sqrt("variance").alias("stdev"), "variance", *points)


def histogram(df: DataFrame, group: Sequence[str], value: str | Column, bins: int = 10) -> DataFrame:
    """``group..., bin, low, high, count`` for equal-width bins from the group's minimum to its maximum, empty bins included."""
    source = _Scalars(df, group, value)
    return _unkeyed(_histogram(source, gathered(source.sizes()), bins))


def _histogram(source: _Scalars, groups: tuple[DataFrame, pa.Table | None], bins: int) -> DataFrame:
    if bins < 1:
        raise ValueError("bins must be at least 1")
    keys, (ends, known) = source.keys, groups
    counts = source.bin_counts(ends, known, bins)
    every = ends.select(*keys, "min", "max", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("max") - F.col("min")) / bins
    return join_groups(every, counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("min") + F.col("bin") * width).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("max")).otherwise(F.col("min") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def histogram_array(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins folded into one array per group: ``keys..., histogram array<bigint>``."""
    ordered = F.array_sort(F.collect_list(F.struct("bin", "count")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda b: b["count"]).alias("histogram"))


def describe(
    df: DataFrame, group: Sequence[str], value: str | Column, bins: int = 10, crowded_rows: int = CROWDED_ROWS
) -> DataFrame:
    """The summary of each group with its histogram as an array."""
    return _unkeyed(_described(_Scalars(df, group, value), bins, crowded_rows))


def _described(source: _Scalars, bins: int, crowded_rows: int) -> DataFrame:
    positions = _percentile_positions(PERCENTILES)
    moments = _placed(source.moments(_shares(positions)), positions)
    counts = histogram_array(_histogram(source, moments, bins), source.keys)
    return join_groups(_summary(source, moments, list(positions), crowded_rows), counts, source.keys)


def quartiles_exclusive(
    df: DataFrame, group: Sequence[str], value: str | Column, crowded_rows: int = CROWDED_ROWS
) -> DataFrame:
    """Median and the medians of the lower and upper halves, the median itself left out: ``group..., n, q1, median, q3``.

    A group of one has empty halves, whose medians are NULL.
    """
    source, n = _Scalars(df, group, value), F.col("n")
    half = F.floor(n / 2)
    inner = F.when(half > 0, (half + 1) / 2)
    positions = {"q1": (0.25, inner), "median": (0.5, (n + 1) / 2), "q3": (0.75, n - half + inner)}
    out = _values_at(source, _placed(source.sizes(_shares(positions)), positions), list(positions), crowded_rows)
    return _unkeyed(out.drop("min", "max"))


def model_shape(df: DataFrame) -> DataFrame:
    """``words, dimensionality`` of the table; fails when the vectors differ in size."""
    shape = df.agg(
        F.count(F.lit(1)).alias("words"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")
    )
    size = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("vector sizes differ"))).otherwise(F.col("low"))
    return shape.select("words", size.cast("int").alias("dimensionality"))


def dimension_values(df: DataFrame) -> DataFrame:
    """One row per vector element: ``dimension, value``."""
    return df.select(F.posexplode("vector").alias("dimension", "value"))


def _one_model(df: DataFrame) -> DataFrame:
    return df.select(F.lit("").alias("model"), "vector")


def dimension_stats(df: DataFrame, bins: int = 20, crowded_rows: int = CROWDED_ROWS) -> DataFrame:
    """Statistics and histogram of each vector dimension: ``dimension, n, max, ..., histogram``."""
    return _described(_Dimensions(_one_model(df)), bins, crowded_rows).drop("model")


def norm_stats(df: DataFrame, bins: int = 20) -> DataFrame:
    """Statistics and histogram of the vector lengths, which are computed once and stored as a narrow table."""
    return describe(settled(df.select(vec_norm("vector").alias("length"))), [], "length", bins)


def analyze(models: Mapping[str, DataFrame], bins: int = 20) -> DataFrame:
    """Shape, dimension and length statistics of several models as one table.

    One row per model and dimension, and one per model with dimension NULL for the lengths. The models share every pass,
    their rows told apart by name, so the number of jobs does not grow with them.
    """
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("model"), "vector") for name, df in models.items()])
    # Sizes and lengths come from one pass; the lengths are stored as a narrow table.
    narrow = settled(rows.select("model", vec_norm("vector").alias("length"), F.size("vector").alias("size")))
    low, high = F.min("size"), F.max("size")
    size = F.when(low != high, F.raise_error(F.lit("vector sizes differ"))).otherwise(low).cast("int")
    shapes = narrow.groupBy("model").agg(F.count(F.lit(1)).alias("words"), size.alias("dimensionality"))
    lengths = describe(narrow, ["model"], "length", bins).withColumn("dimension", F.lit(None).cast("int"))
    found = _described(_Dimensions(rows), bins, CROWDED_ROWS).unionByName(lengths)
    described = [c for c in found.columns if c not in ("model", "dimension")]
    return found.join(F.broadcast(shapes), "model").select("model", "words", "dimensionality", "dimension", *described)


OUTLIER_RULES = ("full", "p2_p98", "median_iqr")


def outlier_bounds(stats: DataFrame, rule: str = "full", factor: float = 1.0) -> DataFrame:
    """Range shown for each row of statistics: the extremes, the 2nd to 98th percentile, or the median plus and minus
    ``factor`` times the distance between the quartiles."""
    spread = (F.col("p75") - F.col("p25")) * factor
    ranges = {
        "full": (F.col("min"), F.col("max")),
        "p2_p98": (F.col("p2"), F.col("p98")),
        "median_iqr": (F.col("p50") - spread, F.col("p50") + spread),
    }
    if rule not in ranges:
        raise ValueError(f"rule must be one of {OUTLIER_RULES}")
    low, high = ranges[rule]
    return stats.withColumn("range_low", low).withColumn("range_high", high)
