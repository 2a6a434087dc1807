"""Token ids in files compressed by Re-Pair grammars, one grammar per block of whole documents."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordloom.llm.bpe import byte_letters
from wordloom.llm.common import text_bytes
from wordloom.llm.packed import CHUNK_BYTES, mixed

END_ID = 2
# Ids per block, on average.
BLOCK_IDS = 1_000_000
# Blanks of the vocabulary's split below the phonetic letters.
BLANKS = "\t-\r \x85\xa0"
# Numbers of ids and rules are stored in 16 bits where a block has at most so many, else in 32.
NUMBERS = 1 << 16

FILES = """part int, block int, first_id {id}, last_id {id}, n_ids bigint, doc_ids array<{id}>, doc_numbers binary, doc_lengths binary,
    terminals binary, rules binary, lengths binary, body binary"""

# Encoding


def library_encoder(path: str) -> Callable[[list[str] | pa.Array], Iterator[np.ndarray]]:
    """Ids as the tokenizers library gives them for a byte-level vocabulary without added prefix.

    Texts that hold special tokens or letters from the phonetic ones on go through the library itself. For others both
    libraries here cut words alike, so the faster one takes them with the same vocabulary. The vocabulary's split looks ahead
    in one place only: the last of several blanks goes with the word behind them. Texts with such blanks are cut before
    the last one, so that the split needs no looking ahead, which costs a quarter of the time.
    """
    import tiktoken
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    value = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(value[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    # The split of byte-level vocabularies, without (?!\S) for the blanks before the last one.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    fast = tiktoken.Encoding("ids", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    rare = "|".join([r"[\x{1c}-\x{1f}\x{250}-\x{10ffff}]", *map(re.escape, special)])
    before_last = re.compile(f"(?<=[{BLANKS}])(?=[{BLANKS}][^{BLANKS}])")

    def encode(texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        by_library = pc.match_substring_regex(texts, rare).to_pylist()
        in_parts = pc.match_substring_regex(texts, f"[{BLANKS}]{{2}}").to_pylist()
        for text, odd, several in zip(texts, by_library, in_parts):
            text = text.as_py()
            if odd:
                ids = library.encode(text, add_special_tokens=False).ids
            elif several:
                ids = [i for part in before_last.split(text) for i in fast.encode_ordinary(part)]
            else:
                ids = fast.encode_ordinary(text)
            yield np.frombuffer(array("I", ids), np.uint32)

    return encode


# Grammars


def compress(ids: np.ndarray, end: int = END_ID) -> dict[str, np.ndarray]:
    """A Re-Pair grammar of ids: terminals, rules as pairs of numbers, expansion lengths, and the body.

    Numbers below the count of terminals stand for these, others for rules. In each round all pairs are counted, those
    with two or more places become rules where no more frequent pair overlaps them, and these places are replaced; rounds
    go on until no pair occurs twice without overlap. Pairs whose left number ends with ``end`` are left, so a document
    never shares a number with the next one.
    """
    terminals = np.flatnonzero(np.bincount(ids, minlength=end + 1))
    number = np.zeros(int(terminals[-1]) + 1, np.uint32)
    number[terminals] = np.arange(len(terminals))
    body = number[ids]
    closes, lengths = terminals == end, np.ones(len(terminals), np.int64)
    rules = [np.zeros((0, 2), np.uint32)]
    # Places whose pair may occur twice: the others' pairs occur once, and never again, as new pairs have a new number.
    alive = np.flatnonzero(~closes[body[:-1]])
    while len(alive):
        used = len(lengths)
        bits = np.uint64(used.bit_length())
        left, right = body[alive], body[alive + 1]
        pairs = left.astype(np.uint64) << bits | right
        waiting = _overlapping(alive, left, right)
        counted = (np.delete(alive, waiting), np.delete(pairs, waiting)) if len(waiting) else (alive, pairs)
        places, values, starts, counts = _grouped(*counted, 2 * int(bits), len(body))
        often = np.flatnonzero(counts >= 2)
        if not len(often):
            break
        kinds = values[starts[often]]
        ranked = _ranked(counts[often], kinds)
        rank = np.zeros(len(counts), np.int32)
        rank[often[ranked]] = np.arange(1, len(often) + 1)
        # By place, so that all that follows reads in order; no place has rank 0.
        score = np.zeros(len(body) + 1, np.int32)
        score[places] = np.repeat(rank, counts)
        # Neighbours differ in rank, and the most frequent pair gets all its places; a pair left with one place waits.
        peaks = score[:-1] > score[1:]
        peaks[1:] &= score[1:-1] > score[:-2]
        new = np.flatnonzero(peaks)
        uses = np.bincount(score[new], minlength=len(often) + 1)
        new = new[uses[score[new]] >= 2]
        of_kind = np.empty(len(often), np.int64)
        of_kind[ranked] = uses[1:]
        taken = np.flatnonzero(of_kind >= 2)
        named = np.zeros(len(often), np.uint32)
        named[taken] = np.arange(used, used + len(taken))
        made = np.stack([kinds[taken] >> bits, kinds[taken] & np.uint64((1 << int(bits)) - 1)], axis=1).astype(np.uint32)
        # What stays alive: places of pairs that occurred twice, of overlapping ones, and those at and before new numbers.
        live = score > 0
        live[alive[waiting]] = True
        live[new - 1] = True
        body[new] = named[ranked][score[new] - 1]
        keep = np.ones(len(body), bool)
        keep[new + 1] = False
        kept = np.flatnonzero(keep)
        body, live = body[kept], live[kept]
        closes = np.concatenate([closes, closes[made[:, 1]]])
        rules.append(made)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        alive = np.flatnonzero(live[:-1])
        alive = alive[~closes[body[alive]]]
    return {"terminals": terminals.astype(np.uint32), "rules": np.concatenate(rules), "lengths": lengths, "body": body}


def _overlapping(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the sorted places are not counted: in a run of one number every second one."""
    runs = np.flatnonzero(left == right)
    if not len(runs):
        return runs
    starts = np.flatnonzero((np.diff(at[runs], prepend=-2) > 1) | (np.diff(left[runs].astype(np.int64), prepend=-1) != 0))
    odd = (np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))) & 1 == 1
    return runs[odd]


def _grouped(at: np.ndarray, values: np.ndarray, bits: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places below ``room`` with their values, equal ones together, where each group starts, and how many are in it."""
    place = max(room - 1, 1).bit_length()
    if bits + place <= 64:
        packed = np.sort(values << np.uint64(place) | at.astype(np.uint64))
        at, values = (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)
    else:
        order = np.argsort(values)
        at, values = at[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return at, values, starts, np.diff(np.append(starts, len(values)))


def _ranked(counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Order by count, equal counts scattered so that few pairs in a row have rising ranks."""
    low, high = int(len(counts)).bit_length(), int(counts.max()).bit_length()
    if low + high > 48:
        return np.lexsort((mixed(kinds), counts))
    key = counts.astype(np.uint64) << np.uint64(64 - high) | mixed(kinds) >> np.uint64(high)
    number = np.uint64((1 << low) - 1)
    return (np.sort(key & ~number | np.arange(len(counts), dtype=np.uint64)) & number).astype(np.int64)


def _width(numbers: int) -> str:
    return "<u2" if numbers <= NUMBERS else "<u4"


def expansions(grammar: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all numbers, one after the other, and where each number's begin."""
    terminals, rules, lengths = grammar["terminals"], grammar["rules"].astype(np.int64), grammar["lengths"]
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint32)
    out[: len(terminals)] = terminals
    # Rules of a level use numbers of lower levels alone.
    level = np.zeros(len(lengths), np.int64)
    while len(rules):
        deeper = np.maximum(level[rules[:, 0]], level[rules[:, 1]]) + 1
        if np.array_equal(deeper, level[len(terminals) :]):
            break
        level[len(terminals) :] = deeper
    for step in range(1, int(level.max(initial=0)) + 1):
        made = np.flatnonzero(level == step)
        for side, shift in ((0, np.zeros(len(made), np.int64)), (1, lengths[rules[made - len(terminals), 0]])):
            part = rules[made - len(terminals), side]
            places = _ranges(starts[part], lengths[part])
            out[_ranges(starts[made] + shift, lengths[part])] = out[places]
    return out, starts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def expand(grammar: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids that the body's numbers from ``first`` to ``last`` stand for; nothing else of the body is read."""
    table, starts = expansions(grammar)
    part = grammar["body"][first:last].astype(np.int64)
    return table[_ranges(starts[part], grammar["lengths"][part])]


# Files


def _block(part: int, block: int, doc_ids: pa.Array, ids: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    grammar = compress(np.concatenate(ids))
    ends = np.cumsum([len(i) for i in ids])
    through = np.cumsum(grammar["lengths"][grammar["body"]])
    numbers = np.diff(np.searchsorted(through, ends) + 1, prepend=0)
    width = _width(len(grammar["lengths"]))
    named = {
        "part": part,
        "block": block,
        "first_id": doc_ids[0].as_py(),
        "last_id": doc_ids[-1].as_py(),
        "n_ids": int(ends[-1]),
        "doc_ids": doc_ids.to_pylist(),
        "doc_numbers": numbers.astype("<u4").tobytes(),
        "doc_lengths": np.diff(ends, prepend=0).astype("<u4").tobytes(),
        "terminals": grammar["terminals"].astype("<u4").tobytes(),
        "rules": grammar["rules"].astype(width).tobytes(),
        "lengths": grammar["lengths"].astype("<u4").tobytes(),
        "body": grammar["body"].astype(width).tobytes(),
    }
    return pa.RecordBatch.from_pylist([named], schema)


def _grammar(row: dict) -> dict[str, np.ndarray]:
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    width = _width(len(lengths))
    return {
        "terminals": np.frombuffer(row["terminals"], "<u4"),
        "rules": np.frombuffer(row["rules"], width).reshape(-1, 2),
        "lengths": lengths,
        "body": np.frombuffer(row["body"], width),
    }


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode the whole texts and write the ids, each document's with ``end_id`` behind them, in ascending order of id.

    A row of the files is a block of whole documents: its grammar (terminals, rules, expansion lengths), its body, and
    how many numbers and ids each document has there, so that one document is read without the others. Blocks carry
    the range of their doc_ids. Rows are range-partitioned by id, absent ids last, equal ids by the hash of their text.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // (2 * CHUNK_BYTES)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    binary = ["doc_numbers", "doc_lengths", "terminals", "rules", "lengths", "body"]
    fields = [("part", pa.int32()), ("block", pa.int32()), ("first_id", id_type), ("last_id", id_type), ("n_ids", pa.int64())]
    schema = pa.schema([*fields, ("doc_ids", pa.list_(id_type)), *[(b, pa.binary()) for b in binary]])

    def run(batches):
        encode, part, block = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0
        for batch in batches:
            start = 0
            for i, found in enumerate(encode(batch.column(1))):
                ids.append(np.append(found, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= block_ids:
                    names.append(batch.column(0).slice(start, i + 1 - start))
                    yield _block(part, block, pa.concat_arrays(names), ids, schema)
                    names, ids, held, block, start = [], [], 0, block + 1, i + 1
            names.append(batch.column(0).slice(start))
        if ids:
            yield _block(part, block, pa.concat_arrays(names), ids, schema)

    dealt.mapInArrow(run, FILES.format(id=kind.simpleString())).write.parquet(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """``part, block, place, doc_id, ids`` of the files' documents, of all or of those with the given ids.

    For given ids only blocks in whose range they lie are read, and of a block only the numbers of their documents.
    """
    files = spark.read.parquet(path)
    kind = files.schema["first_id"].dataType.simpleString()
    if doc_ids is not None:
        wanted = F.lit(False)
        for i in doc_ids:
            wanted |= (F.col("first_id") <= i) & (F.col("last_id").isNull() | (F.col("last_id") >= i))
        files = files.filter(wanted)
    only = None if doc_ids is None else set(doc_ids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row, only, batch)

    schema = f"part int, block int, place int, doc_id {kind}, ids array<int>"
    return files.mapInArrow(run, schema)


def _documents(row: dict, only: set | None, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    grammar, numbers = _grammar(row), np.frombuffer(row["doc_numbers"], "<u4").astype(np.int64)
    stops = np.cumsum(numbers)
    chosen = [i for i, d in enumerate(row["doc_ids"]) if only is None or d in only]
    if not chosen:
        return
    if only is None:
        parts = np.split(expand(grammar), np.cumsum(np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64))[:-1])
    else:
        parts = [expand(grammar, int(stops[i] - numbers[i]), int(stops[i])) for i in chosen]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int32)))
    n = len(chosen)
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array([row["part"]] * n, pa.int32()),
            "block": pa.array([row["block"]] * n, pa.int32()),
            "place": pa.array(chosen, pa.int32()),
            "doc_id": _typed([row["doc_ids"][i] for i in chosen], batch),
            "ids": lists,
        }
    )


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before: totals per part (a row per part in one task), blocks before it in
    the part, documents before it in the block. Only numbers are moved.
    """
    files = spark.read.parquet(path)
    kind = files.schema["first_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                data = memoryview(expand(_grammar(row)).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                same = [len(lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.int32(row["part"]), same)),
                        pa.array(np.repeat(np.int32(row["block"]), same)),
                        _typed(row["doc_ids"], batch),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "block", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, f"part int, block int, doc_id {kind}, own_start bigint, n_tokens bigint, ids_crc32 bigint")
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_block = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("held")).select("part", F.coalesce(F.sum("held").over(before_part), zero).alias("part_start"))
    blocks = files.select("part", "block", F.coalesce(F.sum("n_ids").over(before_block), zero).alias("block_start")).join(parts, "part")
    placed = rows.join(blocks, ["part", "block"])
    return placed.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def _typed(values: list, batch: pa.RecordBatch) -> pa.Array:
    return pa.array(values, batch.schema.field("doc_ids").type.value_type)
