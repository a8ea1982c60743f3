"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

A rule reads measures of the text, and a measure is computed once and only when a rule that is
reached needs it. On a sample each measure is timed and the outcome of every rule is counted;
the order is then greedy: next comes the rule with the most rejections, among the sample rows
that the rules before leave, per second that its measures still cost. The verdict does not
depend on the order, so neither the sample nor the clock changes which documents are kept.

The cascade is one nested expression in the row: no shuffle, no Python, one pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import table
from bitledger.session import shared_folder

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Symbols a hundred words, repeated lines a hundred lines, mean code points a word.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
WORD_CHARS = (2, 15)
# Rows of the sample (expected) on which costs and rejections are estimated.
SAMPLE_ROWS = 1000
_WORD = r"[^\x20\x09-\x0D]"
_SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(value: Column) -> Column:
    return value.cast("bigint")


def _word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(_SPACE))


def _lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD))
    return let(
        with_word,
        lambda lines: F.struct(
            _long(F.size(lines)).alias("n_lines"), _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")
        ),
    )


def repeat_words(text: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more, the first included."""
    words = F.filter(F.split(text, f"{_SPACE}+", -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        # The last ones are shorter; no two of them have one length, so they equal none.
        return F.transform(h, lambda x, k: F.xxhash64(x, *[F.get(h, k + j) for j in range(1, window)]))

    def twice(pairs: Column) -> Column:
        def equal(one: Column, other: Column) -> Column:
            return F.coalesce(one["h"] == other["h"], F.lit(False))

        found = F.filter(pairs, lambda p, k: equal(p, F.get(pairs, k - 1)) | equal(p, F.get(pairs, k + 1)))
        return F.array_sort(F.transform(found, lambda p: p["at"]))

    def covered(starts: Column) -> Column:
        # Each window adds the words up to the next one, the last all of its own.
        gains = F.transform(
            starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window)))
        )
        return F.aggregate(gains, F.lit(0).cast("bigint"), lambda total, gain: total + gain)

    def count(held: Column) -> Column:
        pairs = F.sort_array(F.transform(held, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        none = F.size(F.array_distinct(held)) == F.size(held)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(let(let(pairs, twice), covered))

    return let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0).cast("bigint")).otherwise(let(windows(h), count)))


@dataclass(frozen=True)
class Measure:
    """Numbers computed together from a text that is not null; ``fields`` are longs."""

    name: str
    fields: tuple[str, ...]
    build: Callable[[Column], Column]

    def struct(self, text: Column) -> Column:
        """A struct of the fields, also where ``build`` gives a single number."""
        value = self.build(text)
        return value if len(self.fields) > 1 else F.struct(_long(value).alias(self.fields[0]))

    @property
    def kind(self) -> str:
        return "struct<" + ",".join(f"{f}:bigint" for f in self.fields) + ">"


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function that gives the column of a field of the rule's ``measures``."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[[Callable[[str], Column]], Column]


MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        Measure("words", ("n_words",), lambda t: F.regexp_count(t, F.lit(f"{_WORD}+"))),
        Measure("characters", ("word_chars",), _word_chars),
        Measure("symbols", ("n_symbols",), lambda t: F.regexp_count(t, F.lit(r"[#*$%&|<>]"))),
        Measure("lines", ("n_lines", "n_dup_lines"), _lines),
        Measure("repeats", ("n_repeat_words",), repeat_words),
    )
}
RULES: tuple[Rule, ...] = (
    Rule("repeated_words", ("repeats", "words"), lambda v: 100 * v("n_repeat_words") > MAX_REPEAT_PERCENT * v("n_words")),
    Rule("few_words", ("words",), lambda v: v("n_words") < MIN_WORDS),
    Rule("symbols", ("symbols", "words"), lambda v: 100 * v("n_symbols") > MAX_SYMBOL_PERCENT * v("n_words")),
    Rule("repeated_lines", ("lines",), lambda v: 100 * v("n_dup_lines") > MAX_DUP_LINE_PERCENT * v("n_lines")),
    Rule(
        "word_length",
        ("characters", "words"),
        lambda v: (v("word_chars") < WORD_CHARS[0] * v("n_words")) | (v("word_chars") > WORD_CHARS[1] * v("n_words")),
    ),
)


@dataclass(frozen=True)
class Estimate:
    """A rule in its place: seconds that its new measures cost on the sample, the sample rows
    that reach it and those of them that it rejects."""

    rule: Rule
    seconds: float
    reached: int
    rejected: int


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _seconds(run: Callable[[], object]) -> float:
    """The shorter of two runs; the first also compiles."""
    times = []
    for _ in range(2):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return min(times)


def _value_of(bound: dict[str, Column], measures: dict[str, Measure]) -> Callable[[str], Column]:
    owner = {f: name for name in bound for f in measures[name].fields}
    return lambda field: bound[owner[field]][field]


def plan_cascade(
    docs: DataFrame,
    rules: Iterable[Rule] = RULES,
    measures: dict[str, Measure] = MEASURES,
    sample_rows: int = SAMPLE_ROWS,
) -> list[Estimate]:
    """The rules in the order of a cascade over ``docs``, estimated on a random sample.

    The sample is written once to the shared folder. Rejections are counted by which rules
    reject a row together, at most as many counts as the sample has rows, so that the choice of
    each next rule is conditional on those before it. Without sample rows the order is given.
    """
    rules = list(rules)
    shared_folder(docs.sparkSession)
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    text = docs.select(_text(docs).alias("text"))
    sample = (text if share == 1.0 else text.sample(share, seed=11)).checkpoint()
    sample = sample.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    used = list(dict.fromkeys(m for r in rules for m in r.measures))
    values = {m: measures[m].struct(F.col("text")) for m in used}

    def spent(column: Column) -> float:
        return _seconds(lambda: sample.agg(F.max(F.xxhash64(column))).first())

    empty = spent(F.col("text"))
    cost = {m: max(spent(values[m]) - empty, 1e-4) for m in used}
    measured = sample.select(*[values[m].alias(m) for m in used])
    value = _value_of({m: F.col(m) for m in used}, measures)
    outcomes = measured.groupBy(*[r.fails(value).alias(f"r{k}") for k, r in enumerate(rules)]).count().collect()
    left = [(tuple(bool(x) for x in row[: len(rules)]), row["count"]) for row in outcomes]
    known: set[str] = set()
    order: list[Estimate] = []
    waiting = list(range(len(rules)))
    while waiting:
        reached = sum(n for _, n in left)

        def price(k: int) -> float:
            return sum(cost[m] for m in rules[k].measures if m not in known)

        def gone(k: int) -> int:
            return sum(n for fails, n in left if fails[k])

        # A rule whose measures are there already is free; ties go to the cheaper, then the earlier.
        best = max(waiting, key=lambda k: (gone(k) / (price(k) + 1e-6), -price(k), -k))
        order.append(Estimate(rules[best], price(best), reached, gone(best)))
        known.update(rules[best].measures)
        left = [(fails, n) for fails, n in left if not fails[best]]
        waiting.remove(best)
    return order


def cascade(text: Column, rules: Iterable[Rule], measures: dict[str, Measure] = MEASURES) -> Column:
    """Struct of ``rejected_by``, the first rule in the given order that fails (null if none
    does), and of the measures by name, null where no rule that was reached needed them."""
    rules = list(rules)
    used = list(dict.fromkeys(m for r in rules for m in r.measures))

    def leaf(name: str | None, bound: dict[str, Column]) -> Column:
        held = [bound.get(m, F.lit(None)).cast(measures[m].kind).alias(m) for m in used]
        return F.struct(F.lit(name).cast("string").alias("rejected_by"), *held)

    def step(k: int, bound: dict[str, Column]) -> Column:
        if k == len(rules):
            return leaf(None, bound)
        new = next((m for m in rules[k].measures if m not in bound), None)
        if new:
            return let(measures[new].struct(text), lambda value: step(k, bound | {new: value}))
        fails = rules[k].fails(_value_of(bound, measures))
        return F.when(fails, leaf(rules[k].name, bound)).otherwise(step(k + 1, bound))

    return step(0, {})


def judge(
    docs: DataFrame, rules: Iterable[Rule] | None = None, measures: dict[str, Measure] = MEASURES
) -> DataFrame:
    """``docs`` with ``rejected_by``, the first failing rule or null, and ``measured``, the
    measures that the cascade had to compute (a struct of structs, null where it had not).

    ``rules`` in the order to apply; without, ``RULES`` in the order that ``plan_cascade``
    estimates. Which documents have no ``rejected_by`` does not depend on the order. Only
    ``text`` is read; null texts count as empty and fail ``few_words``. Columns ``rejected_by``
    and ``measured`` of ``docs`` are replaced, all others stay; repeated rows are judged alike
    and an empty table gives an empty result. A whole text is one row: its words and windows
    are arrays of about 30 bytes a word.
    """
    if rules is None:
        rules = [e.rule for e in plan_cascade(docs, RULES, measures)]
    found = cascade(_text(docs), rules, measures)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("rejected_by", "measured")]
    judged = docs.select(*rest, found.alias("measured"))
    used = [f for f in judged.schema["measured"].dataType.names if f != "rejected_by"]
    return judged.select(
        *rest,
        F.col("measured.rejected_by").alias("rejected_by"),
        F.struct(*[F.col(f"measured.{f}").alias(f) for f in used]).alias("measured"),
    )


def keep_passing(docs: DataFrame, rules: Iterable[Rule] | None = None, measures: dict[str, Measure] = MEASURES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged."""
    if rules is None:
        rules = [e.rule for e in plan_cascade(docs, RULES, measures)]
    return docs.where(cascade(_text(docs), rules, measures)["rejected_by"].isNull())


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and measures of every document. Measures that the cascade did not reach are
    filled in afterwards. Null and empty texts have no words, zeros and ``base_failed``; a null
    ``doc_id`` and repeated rows are judged like others."""
    judged = judge(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    names = [m for m in MEASURES if m in judged.schema["measured"].dataType.names]
    whole = judged.select(
        "doc_id", "rejected_by", *[F.coalesce(F.col(f"measured.{m}"), MEASURES[m].struct(text)).alias(m) for m in names]
    )
    value = _value_of({m: F.col(m) for m in names}, MEASURES)
    failed = (value("n_words") < MIN_WORDS) | (100 * value("n_repeat_words") > MAX_REPEAT_PERCENT * value("n_words"))
    return whole.select(
        "doc_id",
        *[value(f).alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_WORD}')] AS ls
  FROM documents),
g AS (
  SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (
  SELECT k, count(DISTINCT p) AS n
  FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1)
  GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
    OR word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words) AS kept
FROM b
"""
