import gzip
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import bounds
from wordloom.operators import clustering, stats
from wordloom.sources import analogies, binary, tables, text


def model(rows=300, dimensions=7, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(rows, dimensions)).astype(np.float32).astype(np.float64)
    return [f"wörd{i}" if i % 7 == 0 else f"w{i}" for i in range(rows)], vectors


def write_text(path, words, vectors):
    lines = "".join(w + " " + " ".join(repr(float(x)) for x in v) + "\n" for w, v in zip(words, vectors))
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding="utf-8") as file:
        file.write(lines)


def write_binary(path, words, vectors, newline):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wb") as file:
        file.write(f"{len(words)} {vectors.shape[1]}\n".encode())
        for w, v in zip(words, vectors):
            file.write(w.encode() + b" " + struct.pack(f"<{len(v)}f", *v) + (b"\n" if newline else b""))


def check(df, words, vectors):
    rows = df.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(words)))
    assert [r["word"] for r in rows] == words
    assert np.array_equal(np.array([r["vector"] for r in rows]).reshape(len(rows), -1), vectors)


@pytest.mark.parametrize("name", ["m.txt", "m.txt.gz"])
def test_text_plain_and_gz_agree(spark, tmp_path, name):
    words, vectors = model()
    write_text(tmp_path / name, words, vectors)
    df = text.read_text_vectors(spark, str(tmp_path / name))
    assert df.dtypes == [("index", "bigint"), ("word", "string"), ("vector", "array<double>")]
    check(df, words, vectors)


def test_text_index_over_many_splits_and_files(spark, tmp_path):
    words, vectors = model(2000)
    (tmp_path / "d").mkdir()
    write_text(tmp_path / "d" / "a.txt", words[:1500], vectors[:1500])
    write_text(tmp_path / "d" / "b.txt", words[1500:], vectors[1500:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = text.read_text_vectors(spark, str(tmp_path / "d"))
        check(df, words, vectors)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        check(text.read_text_vectors(spark, str(tmp_path / "d")), words, vectors)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_text_bad_rows(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a 1 2  \nb 1  2\nc 3 4\nd 3 x\n")
    path = str(tmp_path / "m.txt")
    with pytest.raises(Exception):
        text.read_text_vectors(spark, path).collect()
    kept = text.read_text_vectors(spark, path, on_error="drop").orderBy("index").collect()
    assert [(r["index"], r["word"], r["vector"]) for r in kept] == [(0, "a", [1.0, 2.0]), (2, "c", [3.0, 4.0])]
    assert [r["index"] for r in text.read_text_rejects(spark, path).orderBy("index").collect()] == [1, 3]


def test_text_empty_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("")
    assert text.read_text_vectors(spark, str(tmp_path / "m.txt")).count() == 0


@pytest.mark.parametrize("name", ["m.bin", "m.bin.gz"])
@pytest.mark.parametrize("newline", [False, True])
def test_binary(spark, tmp_path, name, newline):
    words, vectors = model(500, 300)
    write_binary(tmp_path / name, words, vectors, newline)
    check(binary.read_binary_vectors(spark, str(tmp_path / name)), words, vectors)


@pytest.mark.parametrize("split_bytes", [1, 5000, 40_000])
@pytest.mark.parametrize("newline", [False, True])
def test_binary_over_many_splits(spark, tmp_path, split_bytes, newline):
    # Bytes that look like separators are common in the numbers.
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(700)]
    bits = rng.choice(np.array([0x20, 0x0A, 0x3F, 0x00], dtype=np.uint8), size=(700, 30 * 4))
    vectors = bits.view("<f4").astype(np.float64)
    write_binary(tmp_path / "m.bin", words, vectors, newline)
    df = binary.read_binary_vectors(spark, "file:" + str(tmp_path / "m.bin"), split_bytes=split_bytes)
    check(df, words, vectors)


def test_binary_float_bits_are_widened_exactly(spark, tmp_path):
    values = [float.fromhex(h) for h in ("0x1.28p-10", "-0x1.d6p-11", "-0x1.02p-13", "-0x1.6ap-14")]
    write_binary(tmp_path / "m.bin", ["</s>"], np.array([values]), False)
    row = binary.read_binary_vectors(spark, str(tmp_path / "m.bin")).head()
    assert (row["index"], row["word"], row["vector"]) == (0, "</s>", values)


def test_binary_truncated_and_without_header(spark, tmp_path):
    words, vectors = model(50, 20)
    write_binary(tmp_path / "m.bin", words, vectors, False)
    whole = (tmp_path / "m.bin").read_bytes()
    (tmp_path / "cut.bin").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="ends inside"):
        binary.read_binary_vectors(spark, str(tmp_path / "cut.bin")).collect()
    (tmp_path / "few.bin").write_bytes(b"60 20\n" + whole.split(b"\n", 1)[1])
    with pytest.raises(Exception):
        binary.read_binary_vectors(spark, str(tmp_path / "few.bin")).collect()
    (tmp_path / "none.bin").write_bytes(b"hello")
    with pytest.raises(ValueError, match="no header"):
        binary.read_binary_vectors(spark, str(tmp_path / "none.bin"))


def test_load_model_stores_raw_and_unit_copies(spark, tmp_path):
    words, vectors = model(100, 5)
    vectors[3] = 0.0
    write_text(tmp_path / "tiny.5d.txt.gz", words, vectors)
    write_binary(tmp_path / "other.bin", words, vectors, True)
    out = str(tmp_path / "out")
    stored = tables.load_model(spark, [str(tmp_path / "tiny.5d.txt.gz")], "text", out, dump=True)
    stored |= tables.load_model(spark, [str(tmp_path / "other.bin")], "binary", out)
    assert sorted(stored) == ["other", "tiny.5d"]
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1, norms)[:, None]
    for raw, normalized in stored.values():
        check(tables.read_vectors(spark, raw), words, vectors)
        got = tables.read_vectors(spark, normalized).orderBy("index").collect()
        assert np.allclose([r["vector"] for r in got], unit, atol=1e-12)
    dumped = spark.read.text(out + "/tiny.5d-dump.txt").collect()
    line = next(r["value"] for r in dumped if r["value"].startswith("1\t"))
    assert line.split("\t")[1] == "w1" and np.allclose([float(x) for x in line.split("\t")[2].split(",")], vectors[1])
    with pytest.raises(ValueError):
        tables.load_model(spark, [], "csv", out)


def test_write_vectors_appends(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [1.0])], "index long, word string, vector array<double>")
    tables.write_vectors(df, str(tmp_path / "m"))
    tables.write_vectors(df.withColumn("index", F.lit(1).cast("long")), str(tmp_path / "m"), mode="append")
    assert tables.read_vectors(spark, str(tmp_path / "m")).count() == 2
    tables.write_vectors(df, str(tmp_path / "m"))
    assert tables.read_vectors(spark, str(tmp_path / "m")).count() == 1


def test_read_analogies_takes_direct_files_only(spark, tmp_path):
    (tmp_path / "q" / "mini").mkdir(parents=True)
    (tmp_path / "q" / "family.txt").write_text("boy girl brother sister\nboy girl king queen\n")
    (tmp_path / "q" / "money + co.txt").write_text("japan yen usa dollar\n")
    (tmp_path / "q" / "mini" / "x.txt").write_text("a b c d\n")
    rows = analogies.read_analogies(spark, str(tmp_path / "q")).orderBy("problem_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "family.txt", "boy", "girl", "brother", "sister"),
        (1, "family.txt", "boy", "girl", "king", "queen"),
        (2, "money + co.txt", "japan", "yen", "usa", "dollar"),
    ]


def test_statistics_report(spark, tmp_path):
    words, vectors = model(60, 12)
    df = spark.createDataFrame(
        [(i, w, v.tolist()) for i, (w, v) in enumerate(zip(words, vectors))], "index long, word string, vector array<double>"
    )
    report = tables.statistics_report(stats.analyze({"m": df, "n": df.limit(3)}))
    tables.write_report(report, str(tmp_path / "r"))
    found = {}
    for part in (tmp_path / "r").glob("*.json"):
        for line in part.read_text().splitlines():
            found[json.loads(line)["model"]] = json.loads(line)
    assert set(found) == {"m", "n"}
    m = found["m"]
    assert (m["words"], m["dimensionality"], len(m["dimension_stats"])) == (60, 12, 12)
    for d, s in enumerate(m["dimension_stats"]):
        assert np.isclose(s["max"], vectors[:, d].max()) and sum(s["histogram"]) == 60 and len(s["histogram"]) == 20
    assert np.isclose(m["norm_stats"]["percentiles"]["50"], np.median(np.linalg.norm(vectors, axis=1)))
    assert found["n"]["words"] == 3


def test_nothing_stored_is_left_after_release(spark):
    bounds.release(spark)
    df = spark.range(5)
    kept, path = bounds.settled(df), bounds.scratch(spark, "mine")
    df.write.parquet(path)
    assert kept.count() == 5 and os.path.isdir(path)
    before = os.listdir(bounds.shared_dir(spark))
    assert bounds.release(spark) == 2 and bounds.release(spark) == 0
    assert len(os.listdir(bounds.shared_dir(spark))) == len(before) - 2 and not os.path.isdir(path)


def test_centroids_are_stored_by_name(spark, tmp_path):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], clustering.CENTROIDS)
    path = tables.save_centroids(table, str(tmp_path), "m", 2, 1, 5)
    assert path.endswith("m-kmeans-k-2-runs-1-iteration-5.model")
    assert sorted(map(tuple, tables.load_centroids(spark, str(tmp_path), "m", 2, 1, 5).collect())) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_cluster_lines(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"w{i}", [float(i % 2) * 10 + i * 0.01]) for i in range(9)], "index long, word string, vector array<double>"
    )
    centers = spark.createDataFrame([(7, [0.0]), (8, [10.0]), (9, [500.0])], clustering.CENTROIDS)
    tables.write_cluster_lines(df, centers, str(tmp_path / "lines"), single_file=True)
    (part,) = (tmp_path / "lines").glob("part-*")
    assert part.read_text().splitlines() == ["0:w0,2:w2,4:w4,6:w6,8:w8", "1:w1,3:w3,5:w5,7:w7"]
    parts = clustering.cluster_lines(df, centers, line_members=4).orderBy("representative_index", "part").collect()
    assert [tuple(r) for r in parts] == [(0, 0, "0:w0,2:w2,4:w4,6:w6"), (0, 1, "8:w8"), (1, 0, "1:w1,3:w3,5:w5,7:w7")]


def test_line_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    lines = [f"w{i} {i}.0 {i}.5" for i in range(20_000)]
    for name, part in (("a.txt", lines[:15_000]), ("b.txt", lines[15_000:])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
        df = text.read_text_vectors(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        rows = sorted(df.collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        for k, v in held.items():
            spark.conf.set(k, v)
    assert [(r["index"], r["word"], r["vector"]) for r in rows] == [(i, f"w{i}", [float(i), i + 0.5]) for i in range(20_000)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parts_that_are_no_numbers_fail(spark, tmp_path, ansi):
    (tmp_path / "v.txt").write_text("a 1 2\nb x 3\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a number in line 1"):
            text.read_text_vectors(spark, str(tmp_path / "v.txt")).collect()
        dropped = text.read_text_vectors(spark, str(tmp_path / "v.txt"), on_error="drop").collect()
        assert [r["word"] for r in dropped] == ["a"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
