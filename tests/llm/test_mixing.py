"""Mixing against a plain walk over the sorted texts."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from cohortloom.llm import catalog, mixing

from .conftest import awkward_rows, words


def water_fill(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets by sharing again and again what goes beyond the limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + level * weight[s] >= epochs * sizes[s]}
        for s in over or set(open_):
            gain = min(level * weight[s], epochs * sizes[s] - target[s])
            target[s] += gain
            left -= gain
        open_ -= over
        if not over:
            break
    return target


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = water_fill(sizes)
    want = Counter()
    for source in sizes:
        mine = [(i, len(words(t))) for i, t, s in rows if s == source]
        mine.sort(key=lambda x: (hashlib.md5("/".join(["mix", *([str(x[0])] if x[0] is not None else []), str(x[1])]).encode()).hexdigest(), x[0] or 0, x[1]))
        total, before = sizes[source], 0
        rounds = math.floor(target[source] / total + 1e-9) if total else 0
        rest = math.floor(target[source] - rounds * total + 1e-6)
        for i, size in mine:
            want[i, size, total, min(2 * size, rounds * size + max(0, min(size, rest - before)))] += 1
            before += size
    assert Counter((g.doc_id, g.size, g.source_size, g.taken) for g in got) == want

    taken = defaultdict(int)
    for g in got:
        taken[g.source_size, round(g.target, 3)] += g.taken
        assert 0 <= g.taken <= 2 * g.size
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes) + 1)


@pytest.mark.parametrize("range_rows", [3, 20_000])
def test_awkward_rows(awkward, range_rows):
    check([(r[0], r[1], r[3]) for r in awkward_rows()], mixing.plan(awkward, range_rows=range_rows).collect())


def test_smallest_tables(spark, small):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = catalog.QUERIES["op7_mixing"](spark, small).collect()
    check(rows, got)
    assert sorted(got) == sorted(catalog.QUERIES["op7_mixing"](spark, small).collect())


def test_rows_of_the_mix(awkward):
    plan = mixing.plan(awkward).collect()
    out = mixing.mix(awkward, is_stored=True)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert sum(len(words(r.text)) for r in rows) == sum(p.taken for p in plan)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += len(words(r.text))
    want = Counter()
    for p in plan:
        want[p.doc_id] += p.taken
    assert taken == +want


def test_empty_table(nothing):
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
