"""Quality rules as a short-circuit cascade, in column expressions only.

Every rule is a predicate that rejects a text. On a bounded sample each rule's cost (seconds a row)
and its selectivity (share rejected) are estimated; rules then run in the order of rejections per
cost, and a text that one rule rejects isn't tested by the next. The order changes the work, never
the verdict: a text is kept if no rule rejects it. The base tests' counts are results of their own,
so these tests run first, whatever they cost; their costs are estimated with the others'.

A cost is the slope of a job's time over the rows: the sample is taken so many times over in one task
that what is added takes TELLING seconds, whatever a job itself takes. Costs too small to be told
count as the least that can, so that timing noise doesn't order such rules: their rejections do.

Defined results: a null text has no words, like an empty one, and fails the base test; rows are
judged one by one, so repeated rows, ties and other columns, of whatever names, don't matter; a
very long text is judged whole, in one task. An empty table has no sample and gives no rows: the rules
then run in the order given.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

_WINDOW = 3
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]+"
#: Repeated windows up to which places are looked up in their list; with more, windows are sorted with their places.
_LISTED = 32
#: Seconds of a rule's own work that tell its cost, and the most often that the sample is taken for that.
TELLING, MOST_COPIES = 0.1, 256
#: Names of the base tests in a cascade's costs.
BASE = ("base: few words", "base: repeated windows")


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` makes the predicate from the name of the text's column and those of the base counts."""

    name: str
    rejects: Callable[[Column], Column]


def _without(text: Column, chars: str, by: str = "") -> Column:
    """The text with each of the characters replaced. Plain replacements scan bytes; a pattern would cost several times that."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_in(text: Column) -> Column:
    """The text's words; none for a null."""
    return F.filter(F.split(_without(F.coalesce(text, F.lit("")), _SPACES[1:], " "), " "), lambda w: w != "")


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once: a lambda's variable isn't put back as an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more.

    Windows are compared by 64-bit hashes. Texts whose windows all differ end there. Else the windows in
    the list of repeated hashes keep their places; where that list is long, windows are sorted by
    hash instead and those beside an equal one keep theirs. Places that overlap count once.
    """
    n_windows = F.size(words) - (_WINDOW - 1)

    def covered(places: Column) -> Column:
        nearer = F.transform(places, lambda p, i: F.least(F.lit(_WINDOW), F.when(i + 1 < F.size(places), F.get(places, i + 1) - p).otherwise(F.lit(_WINDOW))))
        return F.aggregate(nearer, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        def beside(x: Column, i: Column) -> Column:
            return (F.get(ordered, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, i + 1)["h"].eqNullSafe(x["h"]))

        return _held(F.array_sort(F.transform(F.filter(ordered, beside), lambda x: x["i"])), covered)

    def of_hashes(hashes: Column) -> Column:
        def twice(ordered: Column) -> Column:
            return F.array_distinct(F.filter(ordered, lambda x, i: x.eqNullSafe(F.get(ordered, i + 1))))

        def placed(found: Column) -> Column:
            listed = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(found, F.get(hashes, i)))
            numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            return F.when(F.size(found) == 0, F.lit(0).cast("long")).when(F.size(found) <= _LISTED, _held(listed, covered)).otherwise(_held(F.array_sort(numbered), repeated))

        return _held(_held(F.sort_array(hashes), twice), placed)

    hashes = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_WINDOW)]))
    return F.when(n_windows < 2, F.lit(0).cast("long")).otherwise(_held(hashes, of_hashes))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(_SPACES)) != "")
    return _held(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


#: What a judged row has beside the columns that are kept, and the text on the way.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "_text")


def with_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, _text and the base counts, which replace kept columns of their names."""
    keep = [c for c in keep if c not in COUNTS]
    given = numbered(docs, keep, text).withColumnRenamed(f"c{len(keep)}", "_text")
    words = _held(words_in(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.length(x)).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", _SYMBOLS, ""))
    return given.withColumn("_of", words).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)],
        "_text",
        F.col("_of.n_words"),
        F.col("_of.word_chars"),
        F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        F.col("_of.n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The rules beyond the base: too many symbols for the words, too many repeated lines, words too long or
#: too short on average, capitals for the most part, and exclamation marks after most words.
RULES: tuple[QualityRule, ...] = (
    QualityRule("symbols", lambda text: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    QualityRule("dup_lines", lambda text: (F.col("n_dup_lines") >= 5) & (100 * F.col("n_dup_lines") > 30 * F.size(F.split(text, "\n")))),
    QualityRule("word_length", lambda text: (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    QualityRule("capitals", lambda text: 10 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > 5 * F.col("word_chars")),
    QualityRule("marks", lambda text: 10 * (F.length(text) - F.length(_without(text, "!"))) > 2 * F.col("n_words")),
)


@dataclass(frozen=True)
class Cascade:
    """Rules in their order, with the seconds a row and the share rejected that led to it, those of the base tests too."""

    rules: tuple[QualityRule, ...]
    cost: dict[str, float]
    rejected: dict[str, float]

    def verdict(self, text: Column) -> Column:
        """Whether the text is kept: a CASE stops at the first rule that rejects."""
        out = None
        for rule in self.rules:
            no = F.coalesce(rule.rejects(text), F.lit(False))
            out = F.when(no, F.lit(False)) if out is None else out.when(no, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _cost(sample: DataFrame, n: int, test: Column) -> float:
    """Seconds that ``test`` takes a row, from what three times more copies of the sample's rows take, in one task."""

    def seconds(copies: int) -> float:
        rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        asked, best = rows.agg(F.sum(test.cast("int"))), math.inf
        for _ in range(3):
            began = time.perf_counter()
            asked.collect()
            best = min(best, time.perf_counter() - began)
        return best

    copies, few = 1, seconds(1)
    while True:
        many = seconds(4 * copies)
        if many - few >= TELLING or 4 * copies >= MOST_COPIES:
            return max(0.0, many - few) / (3 * copies * n)
        copies, few = 4 * copies, many


def plan(docs: DataFrame, rules: Sequence[QualityRule] = RULES, *, text: str = "text", sample_rows: int = 1000) -> Cascade:
    """Order the rules on a sample of ``sample_rows`` texts on average, each row being drawn by itself."""
    total = docs.count()
    if not total:
        return Cascade(tuple(rules), {}, {})
    rows = docs.select(F.col(text).alias("of")).sample(min(1.0, sample_rows / total), seed=11)
    sample = cut(with_counts(rows, "of", []).coalesce(1))
    n = sample.count()
    if not n:
        return Cascade(tuple(rules), {}, {})
    of = F.col("_text")
    tests = {r.name: F.coalesce(r.rejects(of), F.lit(False)) for r in rules} | {BASE[0]: F.size(words_in(of)) < 50, BASE[1]: _held(words_in(of), lambda w: 100 * repeat_words(w) > 50 * F.size(w))}
    least = TELLING / (3 * MOST_COPIES / 4 * n)  # what is below can't be told
    cost = {name: max(least, _cost(sample, n, test)) for name, test in tests.items()}
    row = sample.agg(*[F.avg(test.cast("int")).alias(name) for name, test in tests.items()]).first()

    order = sorted(rules, key=lambda r: (-row[r.name] / cost[r.name], cost[r.name], r.name))
    return Cascade(tuple(order), cost, {name: row[name] for name in tests})


def judge(docs: DataFrame, cascade: Cascade, *, text: str = "text", keep: list[str]) -> DataFrame:
    """Columns ``keep``, the base counts, base_failed and kept, one row per row; no shuffle."""
    counted = with_counts(docs, text, keep).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade.verdict(F.col("_text")))
    return counted.withColumn("kept", kept).drop("_text")
