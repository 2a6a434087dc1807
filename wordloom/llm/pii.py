"""Personal data: patterns with their checks, and terms that reveal a found value by how often both occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled, small_or_settled
from wordloom.llm.common import columns_aside, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The patterns of the contract in a form that Java runs without deep recursion and in linear time: repetitions that
# nothing follows are possessive, and a run that can only match from its first character is entered there or where the
# last match ended. The matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Of a part of zeros alone nothing is left behind its leading zeros.
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?"
# What must be in a text for a kind to match: texts without it are not searched.
HINTS = {"email": "b like '%@%'", "ip": "b like '%.%.%.%'", "card": "b rlike '[0-9]'", "phone": "b like '%+%'"}
DIGITS = "regexp_replace(m, '[^0-9]', '')"
# Luhn: from the right every second digit is doubled, 9 taken off above 9; the sum must end in 0.
LUHN = """aggregate(sequence(1, char_length(d)), 0, (t, i) -> t +
    transform(array(cast(substring(d, char_length(d) - i + 1, 1) as int) * (2 - i % 2)), x -> if(x > 9, x - 9, x))[0]) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": rf"m rlike r'^{PART}(\.{PART}){{3}}$'",
    "card": f"transform(array({DIGITS}), d -> case when char_length(d) between 14 and 19 then {LUHN} else false end)[0]",
    "phone": f"char_length({DIGITS}) between 10 and 15",
}

# Terms are words of letters, of any length, anywhere in the texts that hold a value. HIDDEN stands for letters of values;
# no text has it as a letter.
TERM_PATTERN = r"[\p{L}]+"
HIDDEN = "\ufdd0"
# A value is disclosed by a term that occurs with it in at least SUPPORT different texts and carries at least
# DISCLOSED of the value's information: pointwise mutual information over information content.
SUPPORT = 3
DISCLOSED = 0.9
# Protected entities are values, the parts of values that recur in others, and the kinds. Of a part or a kind there must
# be so many bits of information to disclose: one in more than 1 of 16 texts tells nothing of a person.
INFORMATION = 4.0
# A lower bound of a term's count is taken over one of so many classes of texts.
CLASSES = 16


# Sums and maxima over all earlier elements of an array are taken over whole runs of 256, then inside a run: Spark has no
# running form, and appending to an array copies it each time.
RUN, RUN_BITS = 256, 8
NO_SPANS = "array_repeat(named_struct('s', 0, 'k', 0, 'e', 0, 'm', ''), 0)"


def _located(gaps: str, matches: str, kind: int) -> str:
    """SQL for structs ``s, k, e, m`` of start, kind, end and text of matches, from the gaps around them; code points."""
    add = "0, (q, x) -> q + x"
    return f"""transform(array(zip_with({gaps}, {matches}, (x, y) -> char_length(x) + coalesce(char_length(y), 0))), l ->
      transform(array(transform(sequence(0, shiftright(size(l) - 1, {RUN_BITS})), c -> aggregate(slice(l, c * {RUN} + 1, {RUN}), {add}))), t ->
        transform(array(transform(sequence(0, size(t) - 1), c -> aggregate(slice(t, 1, c), {add}))), o ->
          transform({matches}, (m, i) -> transform(
            array(o[shiftright(i, {RUN_BITS})] + aggregate(slice(l, i - i % {RUN} + 1, i % {RUN}), {add}) + char_length({gaps}[i])),
            p -> named_struct('s', p, 'k', {kind}, 'e', p + char_length(m), 'm', m))[0]))[0])[0])[0]"""


def _found(kind: int) -> str:
    """SQL over ``b`` for the valid matches of a kind: structs ``s, k, e, m``.

    A split by the pattern gives the gaps between its matches, so starts are sums of lengths.
    """
    name = KINDS[kind]
    pattern = PATTERNS[name]
    return f"""transform(array(if({HINTS[name]}, regexp_extract_all(b, r'{pattern}', 0), array_repeat('', 0))), f ->
      if(size(f) = 0, {NO_SPANS}, transform(array(split(b, r'{pattern}', -1)), g ->
        filter({_located("g", "f", kind)}, v -> transform(array(v.m), m -> {VALID[name]})[0]))[0]))[0]"""


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds in order of start, then kind: ``array<struct<s, k, e, m>>``, ends exclusive.

    Matches of one kind do not overlap; those of different kinds may. An absent text has none.
    """
    found = ", ".join(_found(k) for k in range(len(KINDS)))
    sql = f"transform(array(coalesce(cast(_p_text as string), '')), b -> array_sort(concat({found})))[0]"
    return F.expr(sql)


def _masked(text: str) -> str:
    """SQL for a text with the letters of its found values hidden, at the same length.

    Only e-mail addresses hold letters, and each match of their pattern is valid. A run of letters and HIDDEN is a run
    of letters of the text, and one that overlaps a found value has HIDDEN in it.
    """
    email = PATTERNS["email"]
    return f"""transform(array(translate({text}, '{HIDDEN}', ' ')), t -> if({HINTS["email"].replace("b ", "t ", 1)},
      array_join(zip_with(split(t, r'{email}', -1), regexp_extract_all(t, r'{email}', 0),
        (g, m) -> concat(g, coalesce(regexp_replace(m, '[A-Za-z]', '{HIDDEN}'), ''))), ''), t))[0]"""


RUN_PATTERN = rf"[\p{{L}}{HIDDEN}]+"


def _terms(text: str) -> str:
    """SQL for the distinct terms of a text that occur outside its found values."""
    words = f"filter(regexp_extract_all({_masked(text)}, r'{RUN_PATTERN}', 0), w -> not contains(w, '{HIDDEN}'))"
    return f"array_distinct(transform({words}, w -> lower(w)))"


def _places(text: str, names: str) -> str:
    """SQL for every place of the named terms outside found values: structs ``s, k, e, m``; none where names are null."""
    return f"""if({names} is null, {NO_SPANS}, transform(array({_masked(text)}), c ->
      transform(array(regexp_extract_all(c, r'{RUN_PATTERN}', 0)), f -> if(size(f) = 0, {NO_SPANS},
        transform(array(split(c, r'{RUN_PATTERN}', -1)), g -> transform(
          filter({_located("g", "f", len(KINDS))}, v -> array_contains({names}, lower(v.m))),
          v -> named_struct('s', v.s, 'k', v.k, 'e', v.e, 'm', lower(v.m))))[0]))[0])[0])"""


# What is protected, by kind: the value; parts that recur in other values; the kind itself, which says that a text holds one.
ENTITIES = {
    "email": "concat('email:', m), concat('email-host:', substring_index(m, '@', -1)), "
    "concat('email-name:', regexp_replace(substring_index(m, '@', 1), '[^a-z]', '')), 'email'",
    "ip": "concat('ip:', m), concat('ip-net:', substring_index(m, '.', 2)), 'ip'",
    "card": f"concat('card:', m), concat('card-issuer:', left({DIGITS}, 6)), 'card'",
    "phone": f"concat('phone:', m), concat('phone-area:', left({DIGITS}, 4)), 'phone'",
}


def _held(rows: DataFrame) -> DataFrame:
    """``_h, entity``: the different protected entities of the different texts; a part with nothing in it is none."""
    cases = " ".join(f"when {i} then array({ENTITIES[k]})" for i, k in enumerate(KINDS))
    entities = f"array_distinct(flatten(transform(_b, v -> transform(array(lower(v.m)), m -> case v.k {cases} end)[0])))"
    return rows.select("_h", F.explode(F.expr(f"filter({entities}, v -> not endswith(v, ':'))")).alias("entity")).distinct()


def _holding(texts: DataFrame, held: DataFrame, values: DataFrame) -> DataFrame:
    """``_h, entities, terms`` of each different text that holds one of ``values``."""
    entities = held.join(values, "entity").groupBy(F.col("_h").alias("_t")).agg(F.collect_list(F.struct("entity", "with_value", "most")).alias("entities"))
    found = texts.join(small_or_settled(entities), F.col("_h") == F.col("_t")).select("_h", "entities", F.expr(_terms("text")).alias("terms"))
    return found.groupBy("_h").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def _met(holding: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_h, term, seen, entity, with_value`` for each text, each of its wanted terms and each value that the term may disclose."""
    words = holding.select("_h", "entities", F.explode("terms").alias("term")).join(wanted, "term")
    met = words.select("_h", "term", "seen", F.explode(F.expr("filter(entities, v -> v.most >= seen)")).alias("v"))
    return met.select("_h", "term", "seen", "v.entity", "v.with_value")


def _counted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, with_term``: in how many different texts each wanted term occurs."""
    words = f"array_distinct(transform(regexp_extract_all(text, r'{TERM_PATTERN}', 0), t -> lower(t)))"
    found = texts.select("_h", F.explode(F.expr(words)).alias("term")).join(wanted.select("term"), "term", "left_semi")
    return found.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))


def disclosing_terms(docs: DataFrame, held: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``_h, term``: terms of texts that reveal a value of the same text, from counts over all texts.

    With p as the share of texts: information content IC(v) = -log2 p(v); PMI(t, v) = log2(p(t, v) / (p(t) p(v)));
    a pair is kept when PMI >= ``disclosed`` * IC and at least ``support`` different texts hold both. A text counts once
    however many copies of it there are. The condition on the PMI is a bound on the number of texts with the term, which
    grows with that of texts with both, so values and terms that cannot pass are dropped by their own counts first. Parts of
    values and kinds are entities like values, where IC is at least ``INFORMATION``.
    """
    texts = docs.select(F.xxhash64(whole_text()).alias("_h"), whole_text().alias("text"))
    total = float(max(texts.select("_h").distinct().count(), 1))

    def most(both: str) -> Column:
        return F.col(both) * F.pow(total / F.col("with_value"), F.lit(1 - disclosed)) * (1 + 1e-9)

    values = held.groupBy("entity").agg(F.count(F.lit(1)).alias("with_value"))
    whole = F.col("entity").rlike("^[a-z]+:")
    tells = (F.col("with_value") < total) & (whole | (F.col("with_value") * 2**INFORMATION <= total))
    values = settled(values.filter((F.col("with_value") >= support) & tells).withColumn("most", most("with_value")))
    holding = settled(_holding(texts, held, values))
    # Texts with the term among those that hold such values are a part of all texts with the term.
    seen = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    highest = values.agg(F.max("most")).head()[0] or 0.0
    met = _met(holding, small_or_settled(seen.filter((F.col("seen") >= support) & (F.col("seen") <= highest))))
    pairs = met.groupBy("entity", "with_value", "term", "seen").agg(F.count(F.lit(1)).alias("both"))
    pairs = settled(pairs.filter((F.col("both") >= support) & (F.col("seen") <= most("both"))))
    limits = pairs.groupBy("term").agg(F.max(most("both")).alias("limit"))
    # Texts of one class of hashes alone rule out the common words; only the others are counted in all texts.
    limits = small_or_settled(limits)
    some = _counted(texts.filter(F.pmod("_h", F.lit(CLASSES)) == 0), limits)
    common = small_or_settled(some.join(limits, "term").filter(F.col("with_term") > F.col("limit")).select("term"))
    counts = _counted(texts, small_or_settled(limits.join(common, "term", "left_anti")))
    scored = pairs.join(counts, "term")
    pmi = F.log2(F.col("both") * total / (F.col("with_term") * F.col("with_value")))
    kept = settled(scored.filter(pmi >= disclosed * -F.log2(F.col("with_value") / total)).select("entity", "term", "seen"))
    again = _met(holding, small_or_settled(kept.select("term", "seen").distinct()))
    return again.join(small_or_settled(kept.select("entity", "term")), ["entity", "term"]).select("_h", "term").distinct()


def find_personal(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with ``_b``, the checked matches, and ``_spans``, these and the revealing terms: structs ``s, k, e, m``.

    Terms have kind 4 and come after the others at the same start; every place of a term in a text that holds its value is
    one. The texts are scanned four times (values, terms of texts with values that may be disclosed, counts of terms that may
    pass, spans), and are not shuffled as long as what is joined to them fits a broadcast.

    An absent or empty text has no spans; equal texts have equal spans; repeated rows are kept; an empty table gives
    no rows; columns of any name pass through, but for ``_b``, ``_spans``, ``_h``,
    ``_p_text``, ``_t``, ``_names`` and ``term``, which are made here.
    """
    rows = docs.withColumn("_p_text", whole_text()).withColumn("_b", base_spans(F.col("_p_text"))).withColumn("_h", F.xxhash64("_p_text"))
    terms = disclosing_terms(docs, settled(_held(rows)), support, disclosed)
    by_text = terms.groupBy(F.col("_h").alias("_t")).agg(F.collect_set("term").alias("_names"))
    found = rows.join(small_or_settled(by_text), F.col("_h") == F.col("_t"), "left")
    return found.withColumn("_spans", F.expr(f"array_sort(concat(_b, {_places('_p_text', '_names')}))")).drop("_t", "_names")


def span_text(column: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined in order."""
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, TERM)) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def count_kind(column: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({column}, x -> x.k = {KINDS.index(kind)})) as bigint)")


@columns_aside
def sanitized(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """The documents with found values generalised to their kind in brackets and revealing terms removed.

    Overlapping spans are replaced as one, under the kind of the first. ``n_chars``, where there is one, follows a
    changed text; other texts stay as they are, absent ones absent. Columns of any name pass through, equal texts change
    alike, and an empty table gives no rows.
    """
    found = find_personal(docs, support, disclosed)
    signs = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ", '')"
    # Runs of spans; b is how far the text is copied before each run, a before a span. A run's text p is cut out once.
    rebuilt = f"""transform(array(transform(_spans, x -> x.e)), e ->
      transform(array(transform(sequence(0, shiftright(size(e) - 1, {RUN_BITS})), c -> array_max(slice(e, c * {RUN} + 1, {RUN})))), t ->
        transform(array(transform(sequence(0, size(t)), c -> coalesce(array_max(slice(t, 1, c)), 0))), b ->
          concat(array_join(transform(sequence(0, size(t) - 1), c -> transform(array(substring(_p_text, b[c] + 1, b[c + 1] - b[c])), p ->
            array_join(transform(slice(_spans, c * {RUN} + 1, {RUN}), (x, i) ->
              transform(array(greatest(b[c], array_max(slice(e, c * {RUN} + 1, i)))), a ->
                if(x.s < a, '', concat(substring(p, a - b[c] + 1, x.s - a), {signs}[x.k])))[0]), ''))[0]), ''),
            substring(_p_text, b[size(t)] + 1)))[0])[0])[0]"""
    changed = F.size("_spans") > 0
    out = found.withColumn("_new", F.when(changed, F.expr(rebuilt)).otherwise(F.col("text")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("_new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
