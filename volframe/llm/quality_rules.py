"""Quality rules as a short-circuit cascade ordered by rejections per unit of cost."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, read, save

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Rows of the random sample that sets the rules' order, and files that it comes from at least, where there are more.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 16
#: What a rule costs a row beyond the measures that it needs first, in seconds: a comparison.
COMPARISON_S = 1e-7


@dataclass(frozen=True)
class Rule:
    """A document fails when `fails` is true. `fails` may use the document's columns and those of its `needs`.

    needs: names of measures, see MEASURES. Null never fails.
    """

    name: str
    fails: str
    needs: tuple[str, ...]


#: What a rule can ask for, by SQL over `text`; a later entry may use earlier ones. Each is null-safe through coalesce.
_REPEATED = """CASE WHEN size(_grams) = 0 OR size(array_distinct(_grams)) = size(_grams) THEN 0L ELSE
  transform(array(sort_array(transform(_grams, (g, i) -> struct(g AS g, i AS i)))), a ->
    aggregate(
      sort_array(transform(filter(sequence(0, size(a) - 1),
        k -> (k > 0 AND a[k - 1].g = a[k].g) OR (k < size(a) - 1 AND a[k + 1].g = a[k].g)), k -> a[k].i)),
      named_struct('total', 0L, 'last', -5),
      (t, at) -> named_struct('total', t.total + least(5, at - t.last), 'last', at),
      t -> t.total))[0] END"""
MEASURES: dict[str, str] = {
    "_words": r"array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')",
    "_lines": f"filter(split(coalesce(text, ''), '\\n'), l -> l rlike '{WORD}')".replace("\\", "\\\\"),
    "_hashes": "transform(_words, w -> xxhash64(w))",
    "_grams": "CASE WHEN size(_hashes) < 5 THEN array() ELSE transform(array(_hashes), h -> transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))[0] END",
    "n_words": "CAST(size(_words) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join(_words, '')) AS BIGINT)",
    "n_symbols": f"CAST(size(split(coalesce(text, ''), '[{SYMBOLS}]')) - 1 AS BIGINT)",
    "n_lines": "CAST(size(_lines) AS BIGINT)",
    "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
    "n_repeat_words": _REPEATED,
}
_USES = {"_hashes": ("_words",), "_grams": ("_hashes",), "n_words": ("_words",), "word_chars": ("_words",), "n_lines": ("_lines",), "n_dup_lines": ("_lines",), "n_repeat_words": ("_grams",)}
#: Measures whose values later ones use: each level is a projection of its own. Where a filter on a measure is pushed below
#: them and so made of whole expressions, arrays are still bound once, by an outer lambda, and not for each element.
_LEVELS = (("_words", "_lines"), ("_hashes",), ("_grams",), ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))

#: A document fails the base when it is too short or when over a fifth of its words stand in repeated 5-word windows.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
RULES = (
    Rule("short", "n_words < 10", ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", ("n_words", "n_repeat_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", ("n_words", "word_chars")),
    Rule("same_lines", "10 * n_dup_lines > 4 * n_lines", ("n_lines", "n_dup_lines")),
)


def _with_needs(names: Sequence[str]) -> list[str]:
    wanted = list(names)
    for name in wanted:
        wanted += [x for x in _USES.get(name, ()) if x not in wanted]
    return wanted


def measure(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """docs (a column `text`, any others but those of MEASURES) with the measures of these names.

    A null text counts as empty: no words, no lines, all measures 0. Words are runs of characters other than ASCII
    white space; lines are what \\n separates, and count only if they hold a word. n_repeat_words is the number of
    words inside 5-word windows that occur at least twice in the text; windows are compared by 64-bit hash.
    All of it is Spark SQL over one row at a time: no shuffle, no Python.
    """
    wanted = _with_needs(names)
    for level in _LEVELS:
        if new := [x for x in level if x in wanted]:
            docs = docs.select("*", *(F.expr(MEASURES[x]).alias(x) for x in new))
    return docs.drop(*(x for x in MEASURES if x not in names))


@dataclass(frozen=True)
class Estimates:
    """cost: seconds that each measure takes for the sample once those it uses are there. failing: how many rows of the
    sample fail exactly these rules."""

    rules: tuple[Rule, ...]
    cost: dict[str, float]
    failing: dict[frozenset[str], int]

    def adds(self, rule: Rule, known: Sequence[str]) -> float:
        """What a rule costs where the measures `known` are there already."""
        return COMPARISON_S * sum(self.failing.values()) + sum(self.cost.get(x, 0.0) for x in _with_needs(rule.needs) if x not in known)


def _of_some_files(docs: DataFrame, share: float) -> DataFrame:
    """docs from about this share of its files, SAMPLE_FILES at least, chosen by a hash of their names. Spark leaves the
    others out by name, unread. Whole, where it has few files or is not read from files at all."""
    files = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()}, key=lambda f: hashlib.sha256(f.encode()).digest())
    if len(files) <= SAMPLE_FILES or share >= 1:
        return docs
    try:
        return docs.where(F.col("_metadata.file_name").isin(files[: max(SAMPLE_FILES, math.ceil(share * len(files)))]))
    except AnalysisException:  # docs is not a plain read
        return docs


def _timed(measure: str) -> str:
    """Nanoseconds that the evaluation of a measure takes for a row. The clock is read when the outer and when the inner
    lambda's argument is there, and the measure is worked out in between."""
    now = "CAST(reflect('java.lang.System', 'nanoTime') AS BIGINT)"
    return f"transform(array({now}), _began -> transform(array({MEASURES[measure]}), _value -> {now} - _began + IF(_value IS NULL, 0L, 0L))[0])[0]"


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> Estimates:
    """What each measure costs and which rules fail together, on a random sample of documents.

    The sample (about sample_rows rows, of some files where there are many; both are parameters of the estimate alone) stays
    in Spark, with all measures as columns, so that each is timed by itself, row by row, in one pass over it. It only sets
    the order of the cascade, never which documents are kept. At most 2^(number of rules) counts reach the driver.
    """
    some = _of_some_files(docs, 8 * sample_rows / max(1, docs.count()))
    drawn = some.select("text").sample(fraction=min(1.0, sample_rows / max(1, some.count())), seed=1)
    names = _with_needs(list(dict.fromkeys(x for r in rules for x in r.needs)))
    sample = save(measure(drawn, names), "sample")
    times = sample.select(*(F.expr(_timed(x)).alias(x) for x in names)).agg(*((F.sum(x) / 1e9).alias(x) for x in names), F.count("*").alias("_rows"))
    cost = {}
    for _ in range(2):  # the first pass also compiles
        cost = {x: v or 0.0 for x, v in times.first().asDict().items() if x != "_rows"}
    flags = sample.select(*(F.coalesce(F.expr(r.fails), F.lit(False)).alias(r.name) for r in rules)).groupBy(*(r.name for r in rules)).count().collect() if rules else []
    discard(sample)
    return Estimates(tuple(rules), cost, {frozenset(r.name for r in rules if row[r.name]): row["count"] for row in flags})


def ordered(found: Estimates, known: Sequence[str] = ()) -> list[Rule]:
    """Each next rule is the one with most rejections a second among the rows that the rules before it let through; by
    name where that is equal. A rule's seconds are those of the measures that no rule before it has asked for, and that
    are not in `known`."""
    order, left, passing, there = [], list(found.rules), dict(found.failing), set(known)
    while left:
        rejected = {r.name: sum(n for fails, n in passing.items() if r.name in fails) for r in left}
        best = min(left, key=lambda r: (-rejected[r.name] / max(found.adds(r, there), 1e-9), r.name))
        order.append(best)
        left.remove(best)
        there |= set(_with_needs(best.needs))
        passing = {fails: n for fails, n in passing.items() if best.name not in fails}
    return order


def _steps(rules: Sequence[Rule], known: tuple[str, ...] = ()) -> str:
    """The cascade as one expression over `text`: a measure is bound, as a lambda's variable, when a rule first asks
    for it and stays bound for later rules, so that nothing is computed twice or before it is needed."""
    if not rules:
        return "CAST(NULL AS STRING)"
    rule, wanted = rules[0], _with_needs(rules[0].needs)
    new = [x for level in _LEVELS for x in level if x in wanted and x not in known]
    body = f"CASE WHEN {rule.fails} THEN '{rule.name}' ELSE {_steps(rules[1:], (*known, *new))} END"
    for name in reversed(new):
        body = f"transform(array({MEASURES[name]}), {name} -> {body})[0]"
    return body


def cascade(docs: DataFrame, rules: Sequence[Rule], rejected_by: str = "rejected_by", known: Sequence[str] = ()) -> DataFrame:
    """docs with the name of the first rule, in the order given, that a document fails; null if it passes all.

    The cascade stops at the first rule that fails, so dear rules run only on what earlier ones let through. Null and
    empty texts have no words and fail rules on length. known: measures that docs already has as columns.
    """
    return docs.withColumn(rejected_by, F.expr(_steps(rules, tuple(known))))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with their own columns, by the cascade in its estimated order."""
    order = ordered(estimate(docs, rules, sample_rows))
    return cascade(docs, order, "_rejected_by").where("_rejected_by IS NULL").drop("_rejected_by")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the five measures that are asked of every document, base_failed and kept (false if any rule rejects). The
    cascade finds those measures ready and makes the others only for documents that come to a rule which needs them."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = ordered(estimate(docs, rules, sample_rows), names)
    judged = cascade(measure(docs.select("doc_id", "text"), names), order, "_rejected_by", names)
    return judged.select("doc_id", *names, F.expr(BASE_FAILED).alias("base_failed"), F.col("_rejected_by").isNull().alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, list_slice(words, i, i + 4) AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 4 * n_lines) AS kept
FROM m"""
