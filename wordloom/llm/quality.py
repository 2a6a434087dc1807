"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import WORD, columns_aside

# Rows of the sample on which costs and rejections are estimated. It decides the order of the rules, never a verdict.
SAMPLE_ROWS = 256


# SQL over ``b``, the whole text, and ``w``, its words. A transform of one element names a value, so that nothing is
# worked out once per element of another array.
N_WORDS = "cast(size(w) as bigint)"
WORD_CHARS = "cast(char_length(array_join(w, '')) as bigint)"
N_SYMBOLS = "cast(regexp_count(b, '[#*$%&|<>]') as bigint)"
LINES = f"filter(split(b, '\\n', -1), l -> regexp_like(l, r'{WORD}'))"
N_LINES = f"cast(size({LINES}) as bigint)"
N_DUP_LINES = f"transform(array({LINES}), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0]"
# Words in windows of three found twice or more: windows are hashed and sorted, equal neighbours name the repeated
# places, and each place adds the words that the one before it did not cover. A text whose windows all differ is done
# after the comparison of counts.
N_REPEAT_WORDS = """
  transform(array(if(size(w) < 3, array_repeat(0L, 0),
      transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2])))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
        aggregate(
          array_sort(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h), x -> x.i)),
          named_struct('last', -3, 'n', 0L),
          (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)),
          a -> a.n))[0]))[0]
"""
MEASURES = {
    "n_words": N_WORDS,
    "word_chars": WORD_CHARS,
    "n_symbols": N_SYMBOLS,
    "n_lines": N_LINES,
    "n_dup_lines": N_DUP_LINES,
    "n_repeat_words": N_REPEAT_WORDS,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over names of ``MEASURES``; true for a document that fails, never null."""

    name: str
    rejects: str
    base: bool = False


RULES = (
    Rule("few_words", "n_words < 50", base=True),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
)


def _over_text(sql: str) -> Column:
    """SQL over the text column ``_q_text`` with its body and words named."""
    words = f"regexp_extract_all(b, r'{WORD}', 0)"
    return F.expr(f"transform(array(coalesce(cast(_q_text as string), '')), b -> transform(array({words}), w -> {sql})[0])[0]")


def _written_out(rule: Rule) -> str:
    return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"({MEASURES[m[0]]})", rule.rejects)


def _verdict(rejections: list[str]) -> str:
    """SQL that is true where no rejection is: one CASE, so that nothing after the first rejection is worked out."""
    return "case " + " ".join(f"when {r} then false" for r in rejections) + " else true end"


def rule_costs(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds and share of rejected rows of each rule on at most ``rows`` documents, by running each rule alone."""
    taken = docs.select(F.col("text").cast("string").alias("_q_text")).limit(rows).collect()
    sample = docs.sparkSession.createDataFrame(taken, "_q_text string").coalesce(1)
    costs = {}
    for rule in rules:
        rejected = sample.agg(F.count_if(_over_text(_written_out(rule))))
        start = time.perf_counter()
        n = rejected.head()[0]
        costs[rule.name] = (time.perf_counter() - start, n / max(len(taken), 1))
    return costs


def cascade_order(costs: dict[str, tuple[float, float]], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejection per cost, the best first; equal ones by name."""
    return sorted(rules, key=lambda r: (-costs[r.name][1] / max(costs[r.name][0], 1e-9), r.name))


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All measures and the verdict of every document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``.

    The measures are wanted of every row here, so the cascade saves only its own comparisons; ``good_documents``
    works out what the order asks for and no more. The order changes the cost, never a verdict.
    An absent or empty text has no words and fails; repeated rows are judged one by one; an empty table gives no rows;
    columns beside those named are not read.
    """
    order = cascade_order(rule_costs(docs, rules), rules)
    fields = ", ".join(f"'{name}', {sql}" for name, sql in MEASURES.items())
    rows = docs.select("doc_id", F.col("text").alias("_q_text")).select("doc_id", _over_text(f"named_struct({fields})").alias("_q"))
    rows = rows.select("doc_id", "_q.*")
    base = F.expr(_verdict([r.rejects for r in order if r.base]))
    verdict = F.expr(_verdict([r.rejects for r in order]))
    return rows.select("doc_id", *[m for m in MEASURES if m != "n_lines"], (~base).alias("base_failed"), verdict.alias("kept"))


@columns_aside
def good_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns; absent texts are rejected.

    The rules are one CASE in the cascade's order, each with its own measures, so a rejected document costs no
    measure of a later rule. Columns of any name pass through.
    """
    order = cascade_order(rule_costs(docs, rules), rules)
    verdict = _over_text(_verdict([_written_out(r) for r in order]))
    return docs.withColumn("_q_text", docs["text"]).filter(verdict).select(*[docs[c] for c in docs.columns])
