"""The rule cascade against plain Python."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import catalog, rules

from .conftest import awkward_rows, words


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + o for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def verdict(m):
    n, chars, symbols, lines, dup, repeat = m
    base = n < 50 or 100 * repeat > 50 * n
    return base, not base and not (5 * symbols > n or chars < 2 * n or chars > 20 * n or 10 * dup > 5 * lines)


def check(rows, got):
    want = Counter((i, *measures(t), *verdict(measures(t))) for i, t in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_lines, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got) == want


def test_awkward_rows(awkward):
    check([(r[0], r[1]) for r in awkward_rows()], rules.report(awkward).collect())


def test_made_texts(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|\n\té", max_size=80)), min_size=30, max_size=60))
    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        check(list(enumerate(texts)), rules.report(docs).collect())

    run()


def test_cascade_keeps_what_no_rule_rejects(awkward):
    out = rules.cascade(awkward).collect()
    by_text = {r[1]: verdict(measures(r[1]))[1] for r in awkward_rows()}
    assert len(out) == len(awkward_rows())
    for r in out:
        assert (r.failed_rule is None) == by_text[r.text]
        assert r.row == 7 and r.words == ["w"]


def test_order_is_by_rejections_per_second(awkward):
    found = rules.estimate(awkward.selectExpr("coalesce(text, '') AS text"))
    assert {e.name for e in found} == {r.name for r in rules.RULES}
    shares = [e.rejected / e.seconds for e in found]
    assert shares == sorted(shares, reverse=True)


def test_later_rules_are_not_worked_out(spark):
    from pyspark.sql import functions as F

    fails = rules.Rule("fails", (), lambda m: F.raise_error(F.lit("reached")).cast("boolean"))
    docs = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    text = F.col("text")
    name = rules.first_failure(rules._of_text(text), (rules.FEW_WORDS, fails))
    assert docs.select(name.alias("n")).first().n == "few_words"


def test_no_python_in_the_plan(spark, small):
    plan = catalog.QUERIES["op10_quality_rules"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(nothing):
    assert rules.report(nothing).count() == 0 and rules.cascade(nothing).count() == 0
