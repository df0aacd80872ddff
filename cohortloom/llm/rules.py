"""Quality rules as a cascade that stops at the first rule a text fails.

What a rule costs and how many texts it rejects is measured on a bounded sample (``SAMPLE_ROWS`` rows at most); the rules are
then tried in the order of rejections per second. The order decides how much work is done, not what is kept: a text is kept if
no rule rejects it. Every measure is one expression of Spark's own functions, so a rule behind the first failure is never
worked out.

Null texts count as empty: no words, hence rejected by ``few_words``. Repeated rows are judged alike, each by itself; an empty
table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import step
from cohortloom.llm.sqltext import let, words

SAMPLE_ROWS = 2_000

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from a measure's name to its column."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def _symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _three_word_hashes(w: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, each).otherwise(F.array().cast("array<bigint>"))


def _covered(at: Column) -> Column:
    """Words covered by the three-word windows at the given places in order."""
    steps = F.transform(
        at, lambda place, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - place, F.lit(3)))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def _places_of_repeats(hashes: Column) -> Column:
    """Sorted places whose hash occurs again: equal hashes meet when sorted."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        at = F.transform(
            p,
            lambda x, i: F.when(
                F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)), x["i"]
            ),
        )
        return F.sort_array(F.array_compact(at))

    return let(pairs, repeated)


def _repeat_words(text: Column) -> Column:
    def of(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(_places_of_repeats(hashes), _covered))

    return let(words(text), lambda w: let(_three_word_hashes(w), of))


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda text: F.size(words(text)).cast("long"),
    "word_chars": _word_chars,
    "n_symbols": _symbols,
    "n_lines": lambda text: F.size(_lines(text)).cast("long"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}

FEW_WORDS = Rule("few_words", ("n_words",), lambda m: m("n_words") < 50)
REPEATS = Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"))
#: The rules of the base verdict, then those that the cascade adds.
BASE_RULES = (FEW_WORDS, REPEATS)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: 10 * m("n_dup_lines") > 5 * m("n_lines")),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def _of_text(text: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text)


def estimate(texts: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Estimate]:
    """Seconds and share of rejected texts of each rule, on a sample; the best rule first."""
    rows = texts.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = step(texts.select("text").sample(share, seed).limit(sample_rows), "sample")
    found = []
    for rule in rules:
        test = F.avg(F.when(rule.rejects(_of_text(F.col("text"))), 1.0).otherwise(0.0)).alias("rejected")
        sample.agg(test).first()  # compiles the expression
        began = time.perf_counter()
        rejected = sample.agg(test).first()["rejected"] or 0.0
        found.append(Estimate(rule.name, time.perf_counter() - began, rejected))
    return sorted(found, key=lambda e: (-e.rejected / max(e.seconds, 1e-6), e.name))


def first_failure(measure: Callable[[str], Column], rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules are not worked out."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].rejects(measure), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects(measure), rule.name)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: kept), worked out as cheaply as the estimates allow."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = estimate(docs.select(text.alias("text")), rules, sample_rows)
    by_name = {rule.name: rule for rule in rules}
    return docs.withColumn("failed_rule", first_failure(_of_text(text), tuple(by_name[e.name] for e in order)))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All measures of every text, the base verdict and the cascade's: the measures asked for are worked out once and the
    cascade, in its estimated order, is tried on them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = estimate(docs.select(text.alias("text")), rules, sample_rows)
    by_name = {rule.name: rule for rule in rules}
    measured = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[f(text).alias(name) for name, f in MEASURES.items()])
    base = first_failure(F.col, BASE_RULES).isNotNull()
    return measured.select(
        "doc_id", *MEASURES, base.alias("base_failed"),
        F.when(base, False).otherwise(first_failure(F.col, tuple(by_name[e.name] for e in order)).isNull()).alias("kept"),
    )
