"""Word vectors in the binary form: a header line with counts, then a word, a space and little-endian floats per row.

Words vary in length, so no byte of the file says where a row starts. Every split therefore works out, for each
place at which its first row might start, where the first row after the split would then start and how many rows
lie between. Rows found from different places soon coincide, so this costs little more than one walk. Following
these answers from the header gives the true first row of every split, and the splits are decoded in parallel.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from wordloom.operators.kernels import list_column

# Fixed values of the format.
SPACE = 0x20
NEWLINE = 0x0A
FLOAT_BYTES = 4
MAX_WORD_BYTES = 2000

# A split is read whole by one task, so its size does not grow with the file.
SPLIT_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 4096
ROWS = "index long, word string, vector array<double>"


def read_binary_vectors(spark: SparkSession, path: str, encoding: str = "utf-8", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The word table of a binary file, plain or .gz. All executors must be able to open the path.

    A .gz file cannot be entered in the middle: one task decodes it as a stream and its rows are then spread out.
    """
    if str(path).endswith(".gz"):
        rows = spark.range(1, numPartitions=1).mapInArrow(_decode_stream(path, encoding), ROWS)
        return rows.repartition(spark.sparkContext.defaultParallelism * 3, "index")
    words, dimensions, start, size = _header(path)
    split_bytes = max(split_bytes, _row_bytes(dimensions))
    count = max(1, -(-(size - start) // split_bytes))
    answers = spark.range(0, count, 1, count).mapInArrow(
        _walk_splits(path, dimensions, start, size, split_bytes), "split long, leaves binary, rows binary"
    )
    # Walks from different places soon meet, so the answers of a split pack into some hundred bytes.
    walks = {r["split"]: (r["leaves"], r["rows"]) for r in answers.collect()}
    plan, place, index = [], start, 0
    for split in range(count):
        begin, until = _bounds(split, start, size, split_bytes)
        if place < until and index < words:
            leaves, rows = (np.frombuffer(zlib.decompress(packed), np.int64) for packed in walks[split])
            held = min(int(rows[place - begin]), words - index)
            plan.append((place, index, held))
            place, index = int(leaves[place - begin]), index + held
    if index < words:
        raise ValueError(f"{path}: the header says {words} words, the file holds {index}")
    if not plan:
        return spark.createDataFrame([], ROWS)
    return spark.range(0, len(plan), 1, len(plan)).mapInArrow(_decode_splits(path, dimensions, encoding, plan), ROWS)


def _bounds(split: int, start: int, size: int, split_bytes: int) -> tuple[int, int]:
    return start + split * split_bytes, min(size, start + (split + 1) * split_bytes)


def _row_bytes(dimensions: int) -> int:
    """The longest a row can be: a line break left from the row before, the word, a space and the numbers."""
    return 1 + MAX_WORD_BYTES + 1 + FLOAT_BYTES * dimensions


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local or mounted path or of a URL, and the path in it."""
    parsed = urlparse(str(path))
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else str(path)
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    system, inner = located(path)
    return system.open_input_file(inner)


def _header(path: str) -> tuple[int, int, int, int]:
    with _open(path) as file:
        size = file.size()
        line, found, _ = file.read(min(size, 256)).partition(b"\n")
    words, dimensions = _parse_header(line, path) if found else _parse_header(b"", path)
    return words, dimensions, len(line) + 1, size


def _parse_header(line: bytes, path: str) -> tuple[int, int]:
    parts = line.split()
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"{path}: no header with the number of words and dimensions")
    return int(parts[0]), int(parts[1])


def _word_end(data: bytes, place: int) -> tuple[int, int]:
    """Where the word of the row at ``place`` starts and where the separator after it is (-1 when it is not in sight)."""
    begin = place + 1 if data[place : place + 1] == b"\n" else place
    ends = [e for e in (data.find(b" ", begin, begin + MAX_WORD_BYTES), data.find(b"\n", begin, begin + MAX_WORD_BYTES)) if e >= 0]
    return begin, min(ends, default=-1)


def _walk_splits(path: str, dimensions: int, start: int, size: int, split_bytes: int):
    longest, numbers = _row_bytes(dimensions), FLOAT_BYTES * dimensions

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as file:
            for batch in batches:
                for split in batch.column("id").to_pylist():
                    begin, until = _bounds(split, start, size, split_bytes)
                    file.seek(begin)
                    data = file.read(min(size, until + longest) - begin)
                    leaves, rows = _leaves(data, until - begin, longest, numbers)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([split]), pa.array([_packed(leaves + begin)]), pa.array([_packed(rows)])],
                        ["split", "leaves", "rows"],
                    )

    return walk


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int64).tobytes(), 9)


def _leaves(data: bytes, until: int, longest: int, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """For each starting place in the first row length: the first row start at or past ``until``, and the rows before it.

    A walk stops where an earlier one has been.
    """
    known: dict[int, tuple[int, int]] = {}
    for first in range(min(longest, until)):
        trail, place = [], first
        while place < until and place not in known:
            trail.append(place)
            _, end = _word_end(data, place)
            # A place that no row can start at leads nowhere; it cannot be on the true path.
            place = end + 1 + numbers if end >= 0 else len(data) + longest
        leaf, rows = known[place] if place < until else (place, 0)
        for steps, visited in enumerate(reversed(trail), 1):
            known[visited] = (leaf, rows + steps)
    starts = [known[p] for p in range(min(longest, until))]
    return np.array([s[0] for s in starts], dtype=np.int64), np.array([s[1] for s in starts], dtype=np.int64)


def _decode_splits(path: str, dimensions: int, encoding: str, plan: list[tuple[int, int, int]]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as file:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    place, index, rows = plan[number]
                    file.seek(place)
                    yield from _rows(file.read, index, rows, FLOAT_BYTES * dimensions, encoding, path)

    return decode


def _decode_stream(path: str, encoding: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with _open(path) as raw, gzip.GzipFile(fileobj=raw) as file:
                words, dimensions = _parse_header(file.readline(256).rstrip(b"\n"), path)
                yield from _rows(file.read, 0, words, FLOAT_BYTES * dimensions, encoding, path)

    return decode


def _rows(read, index: int, rows: int, numbers: int, encoding: str, path: str) -> Iterator[pa.RecordBatch]:
    """Decode ``rows`` rows in batches, reading ahead in large pieces."""
    data, place, done = b"", 0, 0
    piece = max(1024 * 1024, 2 * (numbers + MAX_WORD_BYTES + 2))
    while done < rows:
        words, vectors = [], []
        for _ in range(min(BATCH_ROWS, rows - done)):
            if len(data) - place < numbers + MAX_WORD_BYTES + 2:
                data, place = data[place:] + read(piece), 0
            begin, end = _word_end(data, place)
            if end < 0 or end + 1 + numbers > len(data):
                raise ValueError(f"{path}: the file ends inside row {index + done + len(words)}")
            words.append(data[begin:end].decode(encoding))
            vectors.append(data[end + 1 : end + 1 + numbers])
            place = end + 1 + numbers
        values = np.frombuffer(b"".join(vectors), dtype="<f4").astype(np.float64).reshape(len(words), numbers // FLOAT_BYTES)
        positions = np.arange(index + done, index + done + len(words), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(positions), pa.array(words), list_column(values)], ["index", "word", "vector"])
        done += len(words)
