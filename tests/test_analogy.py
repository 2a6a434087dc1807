import numpy as np
import pytest

from wordloom.functions.vectors import to_unit_vectors
from wordloom.operators import analogy
from wordloom.sources import tables

PROBLEMS = "problem_id long, category string, a string, b string, c string, d string"


@pytest.fixture(scope="module")
def words(spark):
    vectors = {
        "man": [1.0, 0.0, 0.1],
        "woman": [1.0, 1.0, 0.1],
        "king": [5.0, 0.0, 0.2],
        "Queen": [5.0, 1.0, 0.2],
        "queen": [0.0, 0.0, 9.0],
        "boy": [0.5, 0.1, 2.0],
        "girl": [0.5, 1.2, 2.0],
    }
    rows = [(i, w, v) for i, (w, v) in enumerate(vectors.items())]
    return spark.createDataFrame(rows, "index long, word string, vector array<double>").repartition(2)


@pytest.fixture(scope="module")
def problems(spark):
    rows = [
        (0, "royal", "man", "woman", "unknown", "x"),
        (1, "royal", "man", "woman", "king", "queen"),
        (2, "royal", "MAN", "WOMAN", "boy", "girl"),
        (3, "royal", "man", "king", "woman", "girl"),
        (4, "lost", "no", "such", "words", "here"),
        (5, "right", "man", "woman", "king", "QUEEN"),
    ]
    return spark.createDataFrame(rows, PROBLEMS)


def answers(df):
    return {(r["problem_id"], r["metric"]): r for r in df.collect()}


def test_answers_are_paired_by_problem(words, problems):
    found = answers(analogy.solve_analogies(words, problems))
    assert len(found) == 12
    # The unsolvable first problem does not shift the answers of the others.
    assert {k: r["word"] for k, r in found.items() if k[1] == "euclidean"} == {
        (0, "euclidean"): "",
        (1, "euclidean"): "Queen",
        (2, "euclidean"): "girl",
        (3, "euclidean"): "Queen",
        (4, "euclidean"): "",
        (5, "euclidean"): "Queen",
    }
    assert found[1, "euclidean"]["correct"] and found[1, "cosine"]["correct"] and not found[3, "euclidean"]["correct"]
    assert (found[0, "cosine"]["score"], found[0, "cosine"]["solved"], found[0, "cosine"]["correct"]) == (0.0, False, False)
    assert found[1, "euclidean"]["score"] == pytest.approx(0.0)


def test_inputs_may_answer_unless_excluded(spark, words):
    problem = spark.createDataFrame([(0, "c", "boy", "boy", "king", "Queen")], PROBLEMS)
    assert answers(analogy.solve_analogies(words, problem))[0, "euclidean"]["word"] == "king"
    assert answers(analogy.solve_analogies(words, problem, exclude_inputs=True))[0, "euclidean"]["word"] == "Queen"


def test_unsolvable_and_words(words, problems):
    assert sorted(r["problem_id"] for r in analogy.unsolvable_problems(words, problems).collect()) == [0, 4]
    assert analogy.problem_words(problems).count() == 15


def test_normalized_path(words, problems):
    assert not analogy.use_normalized_path(words)
    unit = to_unit_vectors(words)
    assert analogy.use_normalized_path(unit)
    assert not analogy.use_normalized_path(words.limit(0))
    plain, fast = (answers(analogy.solve_analogies(unit, problems, normalized=n)) for n in (False, True))
    for key, row in plain.items():
        assert row["word"] == fast[key]["word"] and row["score"] == pytest.approx(fast[key]["score"])


def test_performance(words, problems):
    results = analogy.solve_analogies(words, problems)
    rows = {(r["category"], r["metric"], r["side"]): r for r in analogy.algorithm_performance(results).collect()}
    assert len(rows) == 3 * 2 * 3
    royal = rows["royal", "euclidean", "all"]
    assert (royal["test_count"], royal["n"], royal["accuracy"]) == (4, 4, 0.5)
    assert (rows["royal", "euclidean", "correct"]["n"], rows["royal", "euclidean", "incorrect"]["n"]) == (2, 2)
    # Unsolved problems count with score 0; no correct answer and no wrong answer give empty sides.
    lost = rows["lost", "cosine", "incorrect"]
    assert (lost["accuracy"], lost["n"], lost["max"], lost["histogram"]) == (0.0, 1, 0.0, [1] + [0] * 9)
    assert (rows["lost", "cosine", "correct"]["n"], rows["lost", "cosine", "correct"]["histogram"]) == (0, [])
    assert rows["right", "euclidean", "all"]["accuracy"] == 1.0
    assert (rows["right", "euclidean", "incorrect"]["n"], rows["right", "euclidean", "incorrect"]["p50"]) == (0, 0.0)
    scores = [r["score"] for r in results.filter("category = 'royal' and metric = 'cosine'").collect()]
    assert rows["royal", "cosine", "all"]["p50"] == pytest.approx(np.percentile(scores, 50, method="weibull"))


def test_no_problems(words, problems):
    assert analogy.algorithm_performance(analogy.solve_analogies(words, problems.limit(0))).count() == 0


def test_evaluate_and_report(spark, words, problems, tmp_path):
    models = {"raw": words, "unit": to_unit_vectors(words)}
    performance, misses = analogy.evaluate(models, problems, normalized=True)
    assert performance.count() == 2 * 3 * 2 * 3
    wrong = {(r["model"], r["problem_id"]): r for r in misses.collect()}
    assert {k[1] for k in wrong if k[0] == "raw"} >= {0, 3, 4} and ("raw", 5) not in wrong
    assert wrong["raw", 3]["euclidean_word"] == "Queen" and wrong["raw", 4]["cosine_word"] == ""
    tables.write_report(tables.evaluation_report(performance), str(tmp_path / "e"))
    stored = {(r["model"], r["category"]): r for r in spark.read.json(str(tmp_path / "e")).collect()}
    assert len(stored) == 6
    royal = stored["raw", "royal"]
    assert royal["test_count"] == 4 and royal["euclidean_performance"]["accuracy"] == 0.5
    assert royal["euclidean_performance"]["incorrect_stats"]["percentiles"]["50"] >= 0


def test_vectors_are_not_fetched_to_be_copied(spark, monkeypatch):
    # Neither the vectors of the problems' words nor, beyond the limit, those of the queries pass through the driver.
    rows = [(i, f"w{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "index long, word string, vector array<double>")
    asked = [(i, "c", f"w{i}", f"w{i + 1}", f"w{i + 2}", f"w{i + 3}") for i in range(200)]
    problems = spark.createDataFrame(asked, "problem_id long, category string, a string, b string, c string, d string")
    fetched, fetch = [], type(df).toArrow

    def counted(self):
        found = fetch(self)
        fetched.extend([c for c in self.columns if c == "vector"] * found.num_rows)
        return found

    whole = sorted(analogy.solve_analogies(df, problems).collect())
    monkeypatch.setattr(type(df), "toArrow", counted)
    assert sorted(analogy.solve_analogies(df, problems, broadcast_bytes=1000).collect()) == whole
    assert len(fetched) < 100  # pivots amid a sample
    # Nor do they within it: tasks read the queries where they are stored, and the words' vectors are shuffled.
    fetched.clear()
    assert sorted(analogy.solve_analogies(df, problems).collect()) == whole and not fetched
    plan = analogy.query_vectors(df, problems)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
