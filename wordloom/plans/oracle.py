"""The registered queries as SQL over the same tables, for comparison by another engine."""

from __future__ import annotations

POINTS = (2, 9, 25, 50, 75, 91, 98)
NUMBERS = ["max", "min", "mean", "stdev", "variance", *[f"p{p}" for p in POINTS]]

WORDS = "words AS (SELECT vec_id AS index, concat('w', vec_id) AS word, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
STRETCHED = """stretched AS (SELECT index, word, list_transform(vector, lambda x: x * (1 + index % 5)) AS vector FROM words)"""
CASED = """cased AS (SELECT index, concat(CASE WHEN index % 2 = 0 THEN 'w' ELSE 'W' END, index // 2) AS word, vector FROM words)"""
PROBLEMS = """problems AS (
  SELECT vec_id AS problem_id, concat('c', label) AS category,
         concat('w', vec_id) AS a, concat('w', vec_id + 1) AS b, concat('w', vec_id + 2) AS c,
         CASE vec_id % 3 WHEN 0 THEN concat('w', vec_id + 2) WHEN 1 THEN concat('W', vec_id + 1) ELSE concat('w', vec_id + 3) END AS d
  FROM embeddings)"""
CENTROIDS = """parts AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
centroids AS (SELECT label AS cluster, list(mean ORDER BY pos) AS center
  FROM (SELECT label, pos, avg(x) AS mean FROM parts GROUP BY label, pos) GROUP BY label)"""


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def rounded(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def norm(v: str) -> str:
    return f"sqrt(list_inner_product({v}, {v}))"


def cosine(a: str, b: str) -> str:
    """NULL for a zero vector."""
    return f"(list_inner_product({a}, {b}) / nullif({norm(a)} * {norm(b)}, 0))"


def scaled(v: str) -> str:
    return f"list_transform({v}, lambda x: x / CASE WHEN {norm(v)} = 0 THEN 1 ELSE {norm(v)} END)"


def unit(source: str, name: str = "units") -> str:
    return f"""{name} AS (SELECT index, word, list_transform(vector, lambda x: x / n) AS vector
  FROM (SELECT *, CASE WHEN n0 = 0 THEN 1 ELSE n0 END AS n FROM (SELECT *, {norm('vector')} AS n0 FROM {source})))"""


def combined(a: str, b: str, sign: str) -> str:
    """Element-wise sum or difference."""
    return f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] {sign} {b}[i])"


def pairs(source: str) -> str:
    return f"pairs AS (SELECT l.index, l.vector AS a, r.vector AS b FROM {source} l JOIN {source} r ON r.index = l.index + 1)"


def sums(source: str) -> str:
    return f"{pairs(source)}, queries AS (SELECT index AS qid, {combined('a', 'b', '+')} AS vector FROM pairs)"


def elements(source: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"""SELECT {names}, pos, {r6('x', 'value')} FROM (
  SELECT {names}, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS pos, unnest(vector) AS x FROM {source})"""


def center_elements(source: str, *keys: str) -> str:
    names = ", ".join([*keys, "cluster"])
    return f"""SELECT {names}, pos, {r6('x', 'value')} FROM (
  SELECT {names}, CAST(generate_subscripts(center, 1) - 1 AS INTEGER) AS pos, unnest(center) AS x FROM {source})"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# Statistics over a relation with the group columns and a value v


def percentile(p: float) -> str:
    """Position p (n + 1) / 100 in the sorted list s, linear between ranks."""
    at = f"greatest(1.0::DOUBLE, least(n::DOUBLE, (n + 1) * {p}::DOUBLE / 100.0::DOUBLE))"
    low, high = f"s[floor({at})::BIGINT]", f"s[ceil({at})::BIGINT]"
    return f"({low} + ({at} - floor({at})) * ({high} - {low}))"


def described(source: str, *keys: str) -> str:
    """Sub-query with one row of statistics per group."""
    names = ", ".join(keys) + ", " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    points = ", ".join(f"{percentile(p)} AS p{p}" for p in POINTS)
    return f"""(SELECT {names}n, max, min, mean, sqrt(variance) AS stdev, variance, {points} FROM (
  SELECT {names}count(v) AS n, max(v) AS max, min(v) AS min, avg(v) AS mean, coalesce(var_samp(v), 0) AS variance,
         list(v ORDER BY v) AS s FROM {source} {group}))"""


def histogram(source: str, bins: int, *keys: str) -> str:
    """Sub-query with one row per group and bin, empty bins included."""
    names = ", ".join(keys) + ", " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    same = " AND ".join(f"e.{k} = v.{k}" for k in keys) or "true"
    chosen = "".join(f"e.{k}, " for k in keys)
    return f"""(SELECT {chosen}CAST(b.bin AS INTEGER) AS bin, e.lo + b.bin * ((e.hi - e.lo) / {bins}) AS low,
       CASE WHEN b.bin = {bins - 1} THEN e.hi ELSE e.lo + (b.bin + 1) * ((e.hi - e.lo) / {bins}) END AS high, count(v.v) AS count
  FROM (SELECT {names}min(v) AS lo, max(v) AS hi FROM {source} {group}) e CROSS JOIN range({bins}) b(bin)
  LEFT JOIN {source} v ON {same} AND b.bin = CASE WHEN v.v = e.lo THEN 0 WHEN v.v = e.hi THEN {bins - 1}
       ELSE least(floor((v.v - e.lo) / ((e.hi - e.lo) / {bins})), {bins - 1}) END
  GROUP BY {chosen}b.bin, e.lo, e.hi)"""


def dimensions(source: str, *keys: str) -> str:
    names = "".join(f"{k}, " for k in keys)
    return f"vals AS (SELECT {names}CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS dimension, unnest(vector) AS v FROM {source})"


# Nearest rows and analogies


def scores(queries: str, source: str, metrics: dict[str, str]) -> str:
    """Every query against every row: qid, metric, index, word, score, key (lower is better)."""
    kinds = {
        "euclidean": ("list_distance(q.vector, w.vector)", ""),
        "cosine": (cosine("q.vector", "w.vector"), "-"),
        "unit": (f"(list_inner_product(q.vector, w.vector) / {norm('q.vector')})", "-"),
    }
    selects = []
    for metric, kind in metrics.items():
        score, sign = kinds[kind]
        selects.append(
            f"SELECT qid, '{metric}' AS metric, index, word, score, {sign}score AS key FROM "
            f"(SELECT q.qid, w.index, w.word, {score} AS score FROM {queries} q CROSS JOIN {source} w) WHERE score IS NOT NULL"
        )
    return "scores AS (" + "\nUNION ALL ".join(selects) + ")"


def nearest(n: int) -> str:
    return f"""nearest AS (SELECT * FROM (SELECT qid, metric, index, word, score,
  CAST(row_number() OVER (PARTITION BY qid, metric ORDER BY key, index) AS INTEGER) AS rank FROM scores) WHERE rank <= {n})"""


def query_vectors(source: str) -> str:
    return f"""queries AS (SELECT p.problem_id AS qid,
  list_transform(range(1, len(x.vector) + 1), lambda i: (y.vector[i] - x.vector[i]) + z.vector[i]) AS vector
  FROM problems p JOIN {source} x ON lower(x.word) = lower(p.a) JOIN {source} y ON lower(y.word) = lower(p.b)
  JOIN {source} z ON lower(z.word) = lower(p.c))"""


def results(answers: str) -> str:
    return f"""results AS (SELECT p.problem_id, p.category, p.a, p.b, p.c, p.d, m.metric, coalesce(s.word, '') AS word,
  coalesce(s.score, 0) AS score, s.word IS NOT NULL AS solved, coalesce(lower(s.word) = lower(p.d), false) AS correct
  FROM problems p CROSS JOIN (VALUES ('euclidean'), ('cosine')) m(metric)
  LEFT JOIN {answers} s ON s.qid = p.problem_id AND s.metric = m.metric)"""


def solved(source: str, kind: str = "cosine") -> list[str]:
    return [
        PROBLEMS,
        query_vectors(source),
        scores("queries", source, {"euclidean": "euclidean", "cosine": kind}),
        nearest(1),
        results("nearest"),
    ]


ANSWERS = f"SELECT problem_id, category, metric, word, {r6('score', 'score')}, solved, correct FROM results"


def performance(results_name: str, *keys: str) -> str:
    """Sub-query with one row per group, metric and side."""
    group = [*keys, "metric"]
    names = ", ".join(group)
    same = " AND ".join(f"s.{k} = t.{k}" for k in group) + " AND s.side = t.side"
    sided = f"(SELECT {names}, 'all' AS side, score AS v FROM {results_name} UNION ALL SELECT {names}, CASE WHEN correct THEN 'correct' ELSE 'incorrect' END, score FROM {results_name})"
    numbers = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in NUMBERS)
    return f"""(SELECT {', '.join(f't.{k}' for k in group)}, t.side, t.test_count, t.accuracy, coalesce(s.n, 0) AS n, {numbers}
  FROM (SELECT {names}, side, test_count, accuracy FROM (
      SELECT {names}, count(*) AS test_count, sum(CASE WHEN correct THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
      FROM {results_name} GROUP BY {names}) CROSS JOIN (VALUES ('all'), ('correct'), ('incorrect')) x(side)) t
  LEFT JOIN {described(sided, *group, 'side')} s ON {same})"""


# Clusters


def assigned(source: str, centroids: str = "centroids", name: str = "assigned") -> str:
    return f"""{name} AS (SELECT index, word, vector, cluster, center, sq FROM (
  SELECT w.index, w.word, w.vector, c.cluster, c.center, list_distance(w.vector, c.center) ** 2 AS sq,
         row_number() OVER (PARTITION BY w.index ORDER BY list_distance(w.vector, c.center), c.cluster) AS r
  FROM {source} w CROSS JOIN {centroids} c) WHERE r = 1)"""


def lloyd(source: str, before: str, after: str) -> str:
    return f"""{assigned(source, before, after + '_assigned')},
{after} AS (SELECT b.cluster, coalesce(m.center, b.center) AS center FROM {before} b LEFT JOIN (
  SELECT cluster, list(mean ORDER BY pos) AS center FROM (
    SELECT cluster, pos, avg(x) AS mean FROM (
      SELECT cluster, generate_subscripts(vector, 1) AS pos, unnest(vector) AS x FROM {after}_assigned) GROUP BY cluster, pos)
  GROUP BY cluster) m ON m.cluster = b.cluster)"""


def trained(source: str, k: int, iterations: int, runs: int, seed: int) -> list[str]:
    """``centroids``: Lloyd steps from ``runs`` starts, of which the cheapest is kept. Starts go by the md5 of seed and index."""
    parts = [f"starts AS (SELECT vector, row_number() OVER (ORDER BY md5('{seed}:' || index::VARCHAR), index) - 1 AS place FROM {source})"]
    for run in range(runs):
        parts.append(f"r{run}c0 AS (SELECT (place % {k})::INTEGER AS cluster, vector AS center FROM starts WHERE place // {k} = {run})")
        parts += [lloyd(source, f"r{run}c{i}", f"r{run}c{i + 1}") for i in range(iterations)]
        parts.append(assigned(source, f"r{run}c{iterations}", f"r{run}_last"))
    costs = " UNION ALL ".join(f"SELECT {run} AS run, sum(sq) AS cost FROM r{run}_last" for run in range(runs))
    every = " UNION ALL ".join(f"SELECT {run} AS run, * FROM r{run}c{iterations}" for run in range(runs))
    best = f"SELECT run FROM ({costs}) ORDER BY cost, run LIMIT 1"
    return [*parts, f"centroids AS (SELECT cluster, center FROM ({every}) WHERE run = ({best}))"]


MODELS = """models AS (SELECT 'stretched' AS model, * FROM stretched UNION ALL SELECT 'stretched-normalized', * FROM units)"""
TWO_MODELS = [WORDS, STRETCHED, unit("stretched"), MODELS]
METRICS = {"euclidean": "euclidean", "cosine": "cosine"}
FIRST = r6("vector[1]", "first")


def nearest_to_word(score: str, order: str) -> str:
    return with_(
        WORDS,
        STRETCHED,
        f"""SELECT index, word, {r6('score', 'score')} FROM (
  SELECT w.index, w.word, {score} AS score FROM stretched w, (SELECT vector FROM stretched WHERE word = 'w7') q)
WHERE score IS NOT NULL ORDER BY score {order}, index LIMIT 10""",
    )


def nearest_batch(n: int) -> str:
    return with_(
        WORDS,
        STRETCHED,
        sums("stretched"),
        scores("queries", "stretched", METRICS),
        nearest(n),
        f"SELECT qid, metric, rank, index, word, {r6('score', 'score')} FROM nearest",
    )


def found_words(case_sensitive: bool) -> str:
    same = "c.word = q.query" if case_sensitive else "lower(c.word) = lower(q.query)"
    return with_(
        WORDS,
        CASED,
        f"""SELECT query, index, word, {FIRST} FROM (
  SELECT q.query, c.index, c.word, c.vector, row_number() OVER (PARTITION BY q.query ORDER BY c.index) AS r
  FROM (SELECT DISTINCT upper(word) AS query FROM words) q JOIN cased c ON {same}) WHERE r = 1""",
    )


def evaluated() -> list[str]:
    """Both models solved and graded, in a relation with a model column."""
    return [
        *TWO_MODELS,
        PROBLEMS,
        """queries AS (SELECT x.model, p.problem_id AS qid,
  list_transform(range(1, len(x.vector) + 1), lambda i: (y.vector[i] - x.vector[i]) + z.vector[i]) AS vector
  FROM problems p JOIN models x ON x.word = p.a JOIN models y ON y.word = p.b AND y.model = x.model
  JOIN models z ON z.word = p.c AND z.model = x.model)""",
        f"""scores AS (SELECT *, CASE metric WHEN 'euclidean' THEN score ELSE -score END AS key FROM (
  SELECT q.model, q.qid, 'euclidean' AS metric, w.index, w.word, list_distance(q.vector, w.vector) AS score
  FROM queries q JOIN models w ON w.model = q.model
  UNION ALL SELECT q.model, q.qid, 'cosine', w.index, w.word, {cosine('q.vector', 'w.vector')}
  FROM queries q JOIN models w ON w.model = q.model) WHERE score IS NOT NULL)""",
        """nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, qid, metric ORDER BY key, index) AS r FROM scores) WHERE r = 1)""",
        """results AS (SELECT m.model, p.problem_id, p.category, k.metric, coalesce(s.score, 0) AS score,
  coalesce(lower(s.word) = lower(p.d), false) AS correct
  FROM problems p CROSS JOIN (SELECT DISTINCT model FROM models) m CROSS JOIN (VALUES ('euclidean'), ('cosine')) k(metric)
  LEFT JOIN nearest s ON s.qid = p.problem_id AND s.metric = k.metric AND s.model = m.model)""",
    ]


ORACLE: dict[str, str] = {
    "vector_sum": with_(
        WORDS, pairs("words"), f"sums AS (SELECT index, {combined('a', 'b', '+')} AS vector FROM pairs)", elements("sums", "index")
    ),
    "vector_difference": with_(
        WORDS, pairs("words"), f"sums AS (SELECT index, {combined('a', 'b', '-')} AS vector FROM pairs)", elements("sums", "index")
    ),
    "pair_scores": with_(
        WORDS,
        STRETCHED,
        pairs("stretched"),
        f"""SELECT index, {r6('list_inner_product(a, b)', 'dot')}, {r6('list_distance(a, b)', 'euclidean')},
  {r6('list_distance(a, b) ** 2', 'squared_distance')}, {r6(cosine('a', 'b'), 'cosine_similarity')},
  {r6('1 - ' + cosine('a', 'b'), 'cosine_distance')} FROM pairs""",
    ),
    "normalized_cosine": with_(
        WORDS, STRETCHED, unit("stretched"), pairs("units"), f"SELECT index, {r6('list_inner_product(a, b)', 'score')} FROM pairs"
    ),
    "vector_norm": with_(WORDS, STRETCHED, f"SELECT index, {r6(norm('vector'), 'norm')} FROM stretched"),
    "normalized_check": with_(
        WORDS,
        unit("words"),
        f"""SELECT w.index, abs({norm('w.vector')} - 1) <= 1e-5 AS stored_is_unit, abs(1.5 * {norm('w.vector')} - 1) <= 1e-10 AS longer_is_unit,
  abs({norm('u.vector')} - 1) <= 1e-10 AS scaled_is_unit FROM words w JOIN units u ON u.index = w.index""",
    ),
    "unit_vectors": with_(WORDS, STRETCHED, unit("stretched"), elements("units", "index")),
    "analogy_query_vectors": with_(
        WORDS,
        PROBLEMS,
        query_vectors("words"),
        "named AS (SELECT qid AS problem_id, vector FROM queries)",
        elements("named", "problem_id"),
    ),
    "find_all_words": with_(WORDS, "SELECT index, word FROM words WHERE vector[1] > 0"),
    "find_first_words": with_(WORDS, "SELECT index, word FROM words WHERE vector[1] > 0 ORDER BY index LIMIT 20"),
    "find_word": with_(
        WORDS, CASED, f"SELECT index, word, {FIRST} FROM cased WHERE lower(word) = 'w7' ORDER BY index LIMIT 1"
    ),
    "find_words": found_words(False),
    "find_words_case_sensitive": found_words(True),
    "missing_words": with_(
        WORDS,
        PROBLEMS,
        """SELECT word FROM (SELECT a AS word FROM problems UNION SELECT b FROM problems UNION SELECT c FROM problems
  UNION SELECT d FROM problems) p WHERE NOT EXISTS (SELECT 1 FROM words w WHERE lower(w.word) = lower(p.word))""",
    ),
    "search_whole_word": with_(WORDS, CASED, "SELECT index, word FROM cased WHERE lower(word) = 'w12' ORDER BY index LIMIT 10"),
    "search_substring": with_(
        WORDS, CASED, "SELECT index, word FROM cased WHERE contains(lower(word), 'w1') ORDER BY index LIMIT 10"
    ),
    "search_substring_case_sensitive": with_(
        WORDS, CASED, "SELECT index, word FROM cased WHERE contains(word, 'W1') ORDER BY index LIMIT 10"
    ),
    "nearest_cosine": nearest_to_word(cosine("w.vector", "q.vector"), "DESC"),
    "nearest_euclidean": nearest_to_word("list_distance(w.vector, q.vector)", "ASC"),
    "nearest_by_city_blocks": nearest_to_word("list_sum(list_transform(range(1, len(w.vector) + 1), lambda i: abs(w.vector[i] - q.vector[i])))", "ASC"),
    "nearest_one_batch": nearest_batch(1),
    "nearest_many_batch": nearest_batch(5),
    "nearest_in_cells": nearest_batch(5),
    "nearest_batch_of_unit_vectors": with_(
        WORDS,
        STRETCHED,
        unit("stretched"),
        sums("stretched"),
        scores("queries", "units", {"normalized_cosine": "unit"}),
        nearest(3),
        f"SELECT qid, rank, index, {r6('score', 'score')} FROM nearest",
    ),
    "top_lines_per_flag": """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 10""",
    "top_lines_of_many": """SELECT l_linestatus, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 5000""",
    "best_event_per_type": """SELECT event_type, event_id, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank = 1""",
    "model_shape": "SELECT count(*) AS words, CAST(max(len(embedding)) AS INTEGER) AS dimensionality FROM embeddings",
    "price_summary": with_(
        "vals AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 1000 AS v FROM lineitem)",
        f"SELECT l_returnflag, l_linestatus, n, {rounded(*NUMBERS)} FROM {described('vals', 'l_returnflag', 'l_linestatus')}",
    ),
    "event_summary": with_(
        "vals AS (SELECT event_type, value AS v FROM events)",
        f"SELECT event_type, n, {rounded(*NUMBERS)} FROM {described('vals', 'event_type')}",
    ),
    "event_percentiles": f"""SELECT event_type, n, {r6(percentile(0.5), 'p0_5')}, {r6(percentile(10), 'p10')},
  {r6(percentile(50), 'p50')}, {r6(percentile(99.9), 'p99_9')}
  FROM (SELECT event_type, count(value) AS n, list(value ORDER BY value) AS s FROM events GROUP BY event_type)""",
    "price_percentiles": f"""SELECT n, {', '.join(r6(percentile(p), f'p{p}') for p in POINTS)}
  FROM (SELECT count(l_extendedprice) AS n, list(l_extendedprice ORDER BY l_extendedprice) AS s FROM lineitem)""",
    "price_histogram": with_(
        "vals AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem)",
        f"SELECT l_returnflag, bin, {rounded('low', 'high')}, count FROM {histogram('vals', 25, 'l_returnflag')}",
    ),
    "event_histogram": with_(
        "vals AS (SELECT value AS v FROM events)", f"SELECT bin, {rounded('low', 'high')}, count FROM {histogram('vals', 10)}"
    ),
    "dimension_statistics": with_(
        WORDS, dimensions("words"), f"SELECT dimension, n, {rounded(*NUMBERS)} FROM {described('vals', 'dimension')}"
    ),
    "dimension_histograms": with_(
        WORDS, dimensions("words"), f"SELECT dimension, bin, count FROM {histogram('vals', 20, 'dimension')}"
    ),
    "norm_statistics": with_(
        WORDS,
        STRETCHED,
        f"vals AS (SELECT {norm('vector')} AS v FROM stretched)",
        f"SELECT n, {rounded(*NUMBERS)} FROM {described('vals')}",
    ),
    "analyze_models": with_(
        *TWO_MODELS,
        dimensions("models", "model"),
        f"norms AS (SELECT model, {norm('vector')} AS v FROM models)",
        f"""every AS (SELECT model, dimension, n, {', '.join(NUMBERS)} FROM {described('vals', 'model', 'dimension')}
  UNION ALL SELECT model, -1, n, {', '.join(NUMBERS)} FROM {described('norms', 'model')})""",
        f"""SELECT model, words, dimensionality, dimension, n, {rounded(*NUMBERS)} FROM every JOIN (
  SELECT model, count(*) AS words, CAST(max(len(vector)) AS INTEGER) AS dimensionality FROM models GROUP BY model) USING (model)""",
    ),
    "outlier_ranges": with_(
        WORDS,
        dimensions("words"),
        f"""SELECT dimension, {r6('min', 'full_low')}, {r6('max', 'full_high')}, {r6('p2', 'p2_p98_low')}, {r6('p98', 'p2_p98_high')},
  {r6('p50 - (p75 - p25)', 'median_iqr_low')}, {r6('p50 + (p75 - p25)', 'median_iqr_high')} FROM {described('vals', 'dimension')}""",
    ),
    "quartiles": f"""SELECT event_type, n,
  {r6('(s[((h + 1) / 2.0).floor()::BIGINT] + s[((h + 1) / 2.0).ceil()::BIGINT]) / 2', 'q1')},
  {r6('(s[((n + 1) / 2.0).floor()::BIGINT] + s[((n + 1) / 2.0).ceil()::BIGINT]) / 2', 'median')},
  {r6('(s[(n - h + (h + 1) / 2.0).floor()::BIGINT] + s[(n - h + (h + 1) / 2.0).ceil()::BIGINT]) / 2', 'q3')}
  FROM (SELECT event_type, count(value) AS n, count(value) // 2 AS h, list(value ORDER BY value) AS s FROM events GROUP BY event_type)""",
    "problem_words": with_(
        PROBLEMS, "SELECT a AS word FROM problems UNION SELECT b FROM problems UNION SELECT c FROM problems UNION SELECT d FROM problems"
    ),
    "unsolvable_problems": with_(
        WORDS,
        PROBLEMS,
        """SELECT problem_id, category FROM problems WHERE a NOT IN (SELECT word FROM words)
  OR b NOT IN (SELECT word FROM words) OR c NOT IN (SELECT word FROM words)""",
    ),
    "normalized_path": with_(
        *TWO_MODELS,
        f"""SELECT model, max(abs({norm('vector')} - 1)) <= 1e-10 AS normalized
  FROM (SELECT 'stored' AS model, vector FROM words UNION ALL SELECT model, vector FROM models) GROUP BY model""",
    ),
    "solve_analogies": with_(WORDS, STRETCHED, *solved("stretched"), ANSWERS),
    "solve_analogies_normalized": with_(WORDS, unit("words"), *solved("units", "unit"), ANSWERS),
    "solve_analogies_without_inputs": with_(
        WORDS,
        PROBLEMS,
        query_vectors("words"),
        scores("queries", "words", METRICS),
        """answers AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.metric ORDER BY s.key, s.index) AS r
  FROM scores s JOIN problems p ON p.problem_id = s.qid WHERE s.word NOT IN (p.a, p.b, p.c)) WHERE r = 1)""",
        results("answers"),
        ANSWERS,
    ),
    "evaluation_misses": with_(
        *evaluated(),
        """answers AS (SELECT m.model, p.*, k.metric, coalesce(s.word, '') AS word, coalesce(s.score, 0) AS score,
  coalesce(lower(s.word) = lower(p.d), false) AS correct
  FROM problems p CROSS JOIN (SELECT DISTINCT model FROM models) m CROSS JOIN (VALUES ('euclidean'), ('cosine')) k(metric)
  LEFT JOIN nearest s ON s.qid = p.problem_id AND s.metric = k.metric AND s.model = m.model)""",
        f"""SELECT e.model, e.category, e.problem_id, e.a, e.b, e.c, e.d, e.word AS euclidean_word, {r6('e.score', 'euclidean_score')},
  e.correct AS euclidean_correct, f.word AS cosine_word, {r6('f.score', 'cosine_score')}, f.correct AS cosine_correct
  FROM answers e JOIN answers f ON f.model = e.model AND f.problem_id = e.problem_id
  WHERE e.metric = 'euclidean' AND f.metric = 'cosine' AND NOT (e.correct AND f.correct)""",
    ),
    "evaluate_models": with_(
        *evaluated(),
        f"SELECT model, category, metric, side, test_count, n, {rounded('accuracy', *NUMBERS)} FROM {performance('results', 'model', 'category')}",
    ),
    "analogy_score_histograms": with_(
        WORDS,
        STRETCHED,
        *solved("stretched"),
        """sided AS (SELECT category, metric, 'all' AS side, score AS v FROM results UNION ALL
  SELECT category, metric, CASE WHEN correct THEN 'correct' ELSE 'incorrect' END, score FROM results)""",
        f"SELECT category, metric, side, bin, count FROM {histogram('sided', 10, 'category', 'metric', 'side')}",
    ),
    "incorrect_analogies": with_(
        WORDS,
        STRETCHED,
        *solved("stretched"),
        f"""SELECT category, problem_id, a, b, c, d, e.word AS euclidean_word, {r6('e.score', 'euclidean_score')},
  f.word AS cosine_word, {r6('f.score', 'cosine_score')}
  FROM (SELECT * FROM results WHERE metric = 'euclidean') e
  JOIN (SELECT problem_id, word, score, correct FROM results WHERE metric = 'cosine') f USING (problem_id)
  WHERE NOT (e.correct AND f.correct)""",
    ),
    "assign_clusters": with_(
        WORDS, STRETCHED, CENTROIDS, assigned("stretched"), f"SELECT index, word, cluster, {r6('sq', 'sq_distance')} FROM assigned"
    ),
    "assign_to_many_clusters": with_(
        WORDS,
        STRETCHED,
        "centroids AS (SELECT index::INTEGER AS cluster, vector AS center FROM words)",
        assigned("stretched"),
        f"SELECT index, word, cluster, {r6('sq', 'sq_distance')} FROM assigned",
    ),
    "wsse": with_(WORDS, STRETCHED, CENTROIDS, assigned("stretched"), f"SELECT {r6('sum(sq)', 'wsse')} FROM assigned"),
    "cluster_quality": with_(
        WORDS,
        STRETCHED,
        CENTROIDS,
        assigned("stretched"),
        f"""SELECT CAST((SELECT count(*) FROM centroids) AS INTEGER) AS k, {r6('sum(sq)', 'wsse')},
  {r6('avg(sqrt(sq))', 'mean_distance_to_centroid')}, {r6('avg(1 - ' + cosine('vector', 'center') + ')', 'mean_cosine_distance')} FROM assigned""",
    ),
    "lloyd_step": with_(WORDS, CENTROIDS, lloyd("words", "centroids", "c1"), center_elements("c1")),
    "kmeans_warm_start": with_(
        WORDS,
        CENTROIDS,
        lloyd("words", "centroids", "c1"),
        lloyd("words", "c1", "c2"),
        lloyd("words", "c2", "c3"),
        center_elements("c3"),
    ),
    "kmeans_bounded": with_(
        WORDS,
        CENTROIDS,
        lloyd("words", "centroids", "c1"),
        lloyd("words", "c1", "c2"),
        lloyd("words", "c2", "c3"),
        center_elements("c3"),
    ),
    "kmeans_in_steps": with_(
        WORDS,
        CENTROIDS,
        lloyd("words", "centroids", "c1"),
        lloyd("words", "c1", "c2"),
        lloyd("words", "c2", "c3"),
        lloyd("words", "c3", "c4"),
        "states AS (SELECT CAST(4 AS INTEGER) AS iteration, * FROM c2 UNION ALL SELECT 6, * FROM c4)",
        center_elements("states", "iteration"),
    ),
    "kmeans_train": with_(
        WORDS,
        *trained("words", 10, 5, 2, 42),
        assigned("words"),
        f"""SELECT 10::INTEGER AS k, 5::INTEGER AS iterations, 2::INTEGER AS runs, {r6('sum(sq)', 'wsse')},
  {r6('avg(sqrt(sq))', 'mean_distance_to_centroid')}, {r6('avg(1 - ' + cosine('vector', 'center') + ')', 'mean_cosine_distance')} FROM assigned""",
    ),
    "kmeans_trained_centers": with_(WORDS, *trained("words", 7, 4, 3, 1), center_elements("centroids")),
    "cluster_members": with_(
        WORDS,
        CENTROIDS,
        assigned("words"),
        f"""SELECT cluster, representative_index, concat('w', representative_index) AS representative, index, word, {r6('sq', 'sq_distance')}
  FROM (SELECT *, min(index) OVER (PARTITION BY cluster) AS representative_index FROM assigned)""",
    ),
    "cluster_lines": with_(
        WORDS,
        CENTROIDS,
        assigned("words"),
        """SELECT representative_index, part, string_agg(concat(index, ':', word), ',' ORDER BY index) AS line
  FROM (SELECT *, min(index) OVER (PARTITION BY cluster) AS representative_index,
    CAST((row_number() OVER (PARTITION BY cluster ORDER BY index) - 1) // 20 AS BIGINT) AS part FROM assigned)
  GROUP BY cluster, representative_index, part""",
    ),
    "text_vectors": with_(WORDS, elements("words", "index", "word")),
    "binary_vectors": with_(
        """words AS (SELECT CAST(vec_id // 1000000 AS BIGINT) AS file, CAST(vec_id % 1000000 AS BIGINT) AS index,
  concat('w', vec_id) AS word, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)""",
        elements("words", "file", "index", "word"),
    ),
    "loaded_models": with_(
        WORDS,
        STRETCHED,
        unit("stretched"),
        "models AS (SELECT 'raw' AS model, * FROM stretched UNION ALL SELECT 'normalized', * FROM units)",
        elements("models", "model", "index", "word"),
    ),
    "stored_vectors": with_(WORDS, elements("words", "index", "word")),
    "vector_lines": with_(
        WORDS,
        """SELECT concat(index, chr(9), word, chr(9), array_to_string(list_transform(vector,
  lambda x: CAST(CAST(round(x, 3) AS DECIMAL(10, 3)) AS VARCHAR)), ',')) AS line FROM words""",
    ),
    "analogy_files": with_(
        PROBLEMS,
        "SELECT row_number() OVER (ORDER BY category, problem_id) - 1 AS problem_id, category, a, b, c, d FROM problems",
    ),
    "statistics_report": with_(
        *TWO_MODELS,
        dimensions("models", "model"),
        f"""SELECT model, words, dimensionality, dimension, {r6('mean', 'mean')}, {r6('p50', 'median')} FROM {described('vals', 'model', 'dimension')} JOIN (
  SELECT model, count(*) AS words, CAST(max(len(vector)) AS BIGINT) AS dimensionality FROM models GROUP BY model) USING (model)""",
    ),
    "reported_numbers": with_(
        *TWO_MODELS,
        dimensions("models", "model"),
        f"norms AS (SELECT model, {norm('vector')} AS v FROM models)",
        f"""SELECT model, dimension::INTEGER AS dimension, {rounded(*NUMBERS)} FROM (
  SELECT model, dimension, {', '.join(NUMBERS)} FROM {described('vals', 'model', 'dimension')}
  UNION ALL SELECT model, -1, {', '.join(NUMBERS)} FROM {described('norms', 'model')})""",
    ),
    "reported_histograms": with_(
        WORDS,
        STRETCHED,
        "models AS (SELECT 'stored' AS model, * FROM words UNION ALL SELECT 'stretched', * FROM stretched)",
        dimensions("models", "model"),
        f"norms AS (SELECT model, {norm('vector')} AS v FROM models)",
        f"""SELECT model, dimension::INTEGER AS dimension, bin, count FROM {histogram('vals', 20, 'model', 'dimension')}
UNION ALL SELECT model, -1, bin, count FROM {histogram('norms', 20, 'model')}""",
    ),
    "evaluation_report": with_(
        WORDS,
        STRETCHED,
        *solved("stretched"),
        f"rated AS (SELECT * FROM {performance('results', 'category')})",
        f"""SELECT 'stretched' AS model, category, max(test_count) AS test_count,
  {r6("max(accuracy) FILTER (metric = 'euclidean')", 'euclidean_accuracy')}, {r6("max(accuracy) FILTER (metric = 'cosine')", 'cosine_accuracy')},
  {r6("max(mean) FILTER (metric = 'euclidean' AND side = 'all')", 'euclidean_mean')},
  {r6("max(max) FILTER (metric = 'cosine' AND side = 'incorrect')", 'cosine_incorrect_max')} FROM rated GROUP BY category""",
    ),
    "stored_centroids": with_(CENTROIDS, center_elements("centroids")),
}
