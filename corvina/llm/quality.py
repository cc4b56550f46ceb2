"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is an expression of a text that says whether it rejects it. On a sample of the documents (``sample_rows``
expected, by a seeded Bernoulli sample over the whole table) each rule's cost and selectivity (share that it rejects)
are measured, the rules are ordered by rejection per cost, and they are evaluated as one CASE: a rule's measures are
taken only for texts that the rules before it let pass. The order changes the cost, never the verdict: a document is kept
if no rule rejects it.

Costs are seconds for each row of the expression itself: the rule is run ``repeats`` times over each row of the sample,
and what a rule that does nothing takes for the same rows is taken off, so the latency of a job does not count; of two
runs the quicker one counts, as the first one compiles. Costs are rounded to powers of two, so that rules of like cost
are ordered by what they reject, then by name, and an order is the same from run to run unless a cost lies at a bound.

Null and empty texts count as texts without words: all measures are 0 and the length rule rejects them. Rows that
share a doc_id, and repeated rows, are judged each for itself. An empty table gives an empty result; its rules are
ordered by name. A carried column that has the name of a measure comes as ``<name>_given``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried as carried_names
from .common import written

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8


def bind(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+", -1))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def duplicate_lines(text: Column) -> Column:
    return bind(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text.

    Windows are compared by 64-bit hashes. A text whose window hashes all differ, as nearly all do, needs no more;
    else they are sorted with their places, and the places of equal ones are merged into covered words.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(placed, lambda s: F.filter(s, lambda e, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == e["h"])) | ((j + 1 < F.size(s)) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == e["h"]))))
        starts = F.array_sort(F.transform(again, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return bind(words, counted)


def lines_with(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(pattern)))


Measures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """``rejects``: from measures of a text to a condition."""

    name: str
    rejects: Callable[[Measures], Column]


def expressions(text: Column, words: Column) -> Measures:
    """The measures as expressions of a text (never null) and its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": symbols(text).cast("long"),
        "n_lines": F.size(lines_of(text)).cast("long"),
        "n_dup_lines": duplicate_lines(text).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_digits": (F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))).cast("long"),
        "n_cut_lines": lines_with(text, r"(?:\.\.\.|…)[ \t\x0B\f\r]*\z").cast("long"),
        "n_list_lines": lines_with(text, r"^[ \t]*[-*•]").cast("long"),
    }


#: The measures that ``judge`` gives for every row; the others are taken where the cascade asks for them.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def standard_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda m: m["n_words"] < 20),
        Rule("repeated_passages", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
        Rule("symbols", lambda m: 2 * m["n_symbols"] > 3 * m["n_words"]),
        Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
        Rule("word_length", lambda m: (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
        Rule("digits", lambda m: 2 * m["n_digits"] > m["word_chars"]),
        Rule("cut_lines", lambda m: 10 * m["n_cut_lines"] > 3 * m["n_lines"]),
        Rule("list_lines", lambda m: 10 * m["n_list_lines"] > 9 * m["n_lines"]),
    ]


def with_words(docs: DataFrame, *carried: str) -> DataFrame:
    texts = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.withColumn("_words", words_of(F.col("_text")))


def seconds(texts: DataFrame, condition: Column, times: int) -> tuple[float, float]:
    """Seconds of taking the condition ``times`` over for each row (the quicker of two runs), and its share."""
    again = texts.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))
    asked, took = again.agg(F.avg(condition.cast("double"))), []
    for _ in range(2):
        began = time.perf_counter()
        share = asked.collect()[0][0] or 0.0
        took.append(time.perf_counter() - began)
    return min(took), share


def rounded(cost: float) -> float:
    """To a power of two, from a hundredth of a microsecond on: smaller differences are noise."""
    return 2.0 ** math.ceil(math.log2(max(cost, 1e-8)))


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 7, repeats: int = 8, given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) by rejection per cost on the sample. ``given`` measures are columns that are
    there anyway, and cost nothing but the comparison."""
    total = docs.count()
    sample = with_words(docs.select("text").sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=seed))
    measures = expressions(F.col("_text"), F.col("_words"))
    sample = written(docs.sparkSession, sample.withColumns({n: measures[n] for n in given}), "sample")
    rows = max(sample.count(), 1)
    columns = measures | {n: F.col(n) for n in given}
    nothing, _ = seconds(sample, F.length("_text") < 0, repeats)
    found = []
    for rule in rules:
        took, share = seconds(sample, rule.rejects(columns), repeats)
        found.append((rule, rounded((took - nothing) / (repeats * rows)), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: list[Rule], measures: Measures) -> Column:
    """The name of the first rule that rejects, in the given order; null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(verdict)
    return verdict


def kept(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged. A measure is only taken where a rule asks for it, so what
    the first rules reject costs the others nothing."""
    order = [r for r, _, _ in ordered_rules(docs, standard_rules() if rules is None else rules)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(cascade(order, expressions(text, words_of(text))).isNull())


def judge(docs: DataFrame, rules: list[Rule] | None = None, carried: list[str] | None = None) -> DataFrame:
    """The ``carried`` columns (doc_id) with the measures SHOWN of every row, rejected_by (the cascade's first rule that
    rejects; which one depends on the order) and kept.

    Rules on the measures that are shown compare columns; the other measures are taken inside the cascade, for the texts
    that get so far.
    """
    rules = standard_rules() if rules is None else rules
    names = carried_names(["doc_id"] if carried is None else carried, [*SHOWN, "rejected_by", "kept", "_text", "_words"])
    order = [r for r, _, _ in ordered_rules(docs, rules, given=SHOWN)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    texts = renamed.withColumn("_words", words_of(F.col("_text")))
    measures = expressions(F.col("_text"), F.col("_words"))
    out = texts.withColumns({n: measures[n] for n in SHOWN})
    verdict = cascade(order, measures | {n: F.col(n) for n in SHOWN})
    return out.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("_text", "_words")
