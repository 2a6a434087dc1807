"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by curve index and cut into even runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.bounds import settled
from wordloom.llm.common import whole_text
from wordloom.prefix import running_totals

SHARDS = 16
BITS = 8


def hilbert_index(df: DataFrame, cells: list[str], name: str, bits: int = BITS) -> DataFrame:
    """Add the place of each row's cell on the Hilbert curve through ``len(cells)`` dimensions of ``bits`` bits.

    One step per bit, highest first: the bits of all dimensions name a corner of the current cube; turned into the
    cube's own direction (xor with its entry corner, rotation to its main axis) its rank in Gray-code order is the
    next digit of the index; the digit then gives the sub-cube's entry corner and axis. Corners and ranks are tables
    of 2^n numbers made by rule. The index has n * bits bits, at most 62.
    """
    n, corners = len(cells), 1 << len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("at least 2 dimensions, and dimensions times bits at most 62")
    gray = [i ^ (i >> 1) for i in range(corners)]
    rank = [gray.index(c) for c in range(corners)]
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, corners)]
    ones = [(~w & (w + 1)).bit_length() - 1 for w in range(corners)]
    turn = [0] + [(ones[w - 1] if w % 2 == 0 else ones[w]) % n for w in range(1, corners)]

    def listed(values: list[int]) -> str:
        return "array(" + ", ".join(map(str, values)) + ")"

    mask = corners - 1
    corner = " | ".join(f"shiftleft(shiftright(cast({c} as int), b) & 1, {i})" for i, c in enumerate(cells))
    own = f"((shiftright(x, s.d + 1) | shiftleft(x, {n - 1} - s.d)) & {mask})"
    back = f"((shiftleft(get({listed(entry)}, w), s.d + 1) | shiftright(get({listed(entry)}, w), {n - 1} - s.d)) & {mask})"
    # s.e: entry corner, s.d: main axis, s.h: index so far. A transform of one element names a value in a lambda.
    step = f"""transform(transform(array(({corner}) ^ s.e), x -> get({listed(rank)}, {own})), w -> named_struct(
        'e', s.e ^ {back}, 'd', (s.d + get({listed(turn)}, w) + 1) % {n}, 'h', shiftleft(s.h, {n}) | cast(w as bigint)))[0]"""
    walk = f"aggregate(sequence({bits - 1}, 0, -1), named_struct('e', 0, 'd', 0, 'h', 0L), (s, b) -> {step}, s -> s.h)"
    return df.withColumn(name, F.expr(walk))


def ranked(df: DataFrame, column: str, name: str, bits: int = BITS) -> DataFrame:
    """Add a cell number for a column of names: its rank by code point among the names, spread over all cells; absent 0.

    The ranks are made over one row per name, not over the rows of the table.
    """
    names = df.select(F.col(column).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy("_name")) - 1
    held = F.count(F.lit(1)).over(Window.partitionBy())
    cell = F.floor(place.cast("double") * (1 << bits) / held).cast("int")
    cells = settled(names.select("_name", cell.alias("_cell")))
    return df.join(cells, F.col(column) == F.col("_name"), "left").withColumn(name, F.coalesce("_cell", F.lit(0))).drop("_name", "_cell")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Deal documents to ``shards`` runs of the Hilbert curve: ``doc_id, size, text_crc32, hilbert, shard, slot``.

    Dimensions: source, language, logarithm of the size, and place of the id between the smallest and the largest.
    Rows are sorted by index, then id, then checksum; run lengths differ by at most one row, so a shard covers a
    compact box of all four dimensions and statistics of its files prune on each. Only narrow rows are moved.

    Absent texts have size 1 and checksum 0; absent names are cell 0; an absent id is cell 0 and sorts first; repeated
    rows get a slot each; fewer rows than shards leave shards empty. Columns beside those named are not read.
    """
    data = whole_text().cast("binary")
    narrow = settled(
        docs.select("doc_id", "source", "lang", (F.octet_length(whole_text()).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    )
    ends = narrow.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).head()
    low, high, rows = ends[0] or 0, ends[1] or 0, ends[2]
    top = (1 << bits) - 1
    log = F.least(F.lit(top), F.floor(F.log2("size") * (top / 40)))
    place = F.floor((F.col("doc_id") - low).cast("double") * (top + 1) / (high - low + 1))
    cells = ranked(ranked(narrow, "source", "_source", bits), "lang", "_lang", bits)
    cells = cells.withColumn("_size", log.cast("int")).withColumn("_id", F.coalesce(place, F.lit(0)).cast("int"))
    indexed = hilbert_index(cells, ["_source", "_lang", "_size", "_id"], "hilbert", bits)
    indexed = settled(indexed.select("doc_id", "size", "text_crc32", "hilbert", F.lit(1).cast("long").alias("one")))
    placed = running_totals(indexed, [], ["hilbert", "doc_id", "text_crc32"], "one", "before")
    # The first ``longer`` shards have one row more than the others.
    least, longer = rows // shards, rows % shards
    turn = longer * (least + 1)
    at = F.col("before")
    if least:
        number = F.when(at < turn, F.floor(at / (least + 1))).otherwise(longer + F.floor((at - turn) / least))
    else:
        number = at
    start = F.when(number < longer, number * (least + 1)).otherwise(turn + (number - longer) * least)
    return placed.select("doc_id", "size", "text_crc32", "hilbert", number.cast("int").alias("shard"), (at - start).cast("long").alias("slot"))
