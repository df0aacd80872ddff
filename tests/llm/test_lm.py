"""Scores against a plain n-gram model; the probabilities sum to one."""

import math
import zlib
from collections import Counter

import pytest

from cohortloom.llm import catalog, lm

from .conftest import awkward_rows, words

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


class Plain:
    def __init__(self, rows, order):
        self.order = order
        train = [self.tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
        self.docs = len(train)
        self.counts = Counter()
        for w in train:
            for j in range(len(w)):
                for n in range(1, order + 1):
                    gram = self.gram(w, j, n)
                    if gram:
                        self.counts[gram] += 1
        self.followers = Counter(g[:-1] for g in self.counts if len(g) > 1)
        self.n = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.counts)

    @staticmethod
    def tokens(text):
        return [*words((text or "").translate(LOW)), "</s>"]

    @staticmethod
    def gram(w, j, n):
        padded = ["<s>", *w]
        return tuple(padded[j + 2 - n : j + 2]) if j + 2 >= n else None

    def probability(self, w, j):
        p = (self.counts[(w[j],)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        for n in range(2, self.order + 1):
            gram = self.gram(w, j, n)
            if gram is None:
                break
            context = self.docs if gram[:-1] == ("<s>",) else self.counts[gram[:-1]]
            if context:
                s = self.followers[gram[:-1]]
                p = (self.counts[gram] + s * p) / (context + s)
        return p

    def row(self, i, text):
        w = self.tokens(text)
        base = sum(math.log10((self.counts[(t,)] + 0.5) / (self.n + 0.5 * (self.v + 1))) for t in w)
        return len(w), sum(self.counts[(t,)] > 0 for t in w), self.n, base, sum(math.log10(self.probability(w, j)) for j in range(len(w)))


def check(rows, got, order):
    plain = Plain(rows, order)
    want = sorted(((-1 if i is None else i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, *plain.row(i, t)) for i, t in rows))
    have = sorted((-1 if g.doc_id is None else g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return plain


@pytest.mark.parametrize("order", [1, 2, 4])
def test_awkward_rows(awkward, order):
    got = lm.score(awkward, order, chunk_bytes=3_000, range_grams=500).collect()
    plain = check([(r[0], r[1]) for r in awkward_rows()], got, order)
    for context in (["same"], ["tie", "tie"], []):
        vocabulary = [g[0] for g in plain.counts if len(g) == 1]
        unknown = plain.probability([*context, "never seen"], len(context))
        assert sum(plain.probability([*context, t], len(context)) for t in vocabulary) + unknown == pytest.approx(1)


def test_smallest_tables(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = catalog.QUERIES["op8_backoff_lm"](spark, small).collect()
    check(rows, got, lm.ORDER)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_registered_query_counts_triples(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(rows, catalog.QUERIES["op8_backoff_lm"](spark, small).collect(), 3)


def test_empty_table(nothing):
    assert lm.score(nothing).count() == 0


def test_ngrams_go_out_in_turns_and_contexts_of_one_chunk_stay(awkward, monkeypatch):
    def numbers(rows):
        return sum(int.from_bytes(bytes(r.totals)[:8], "little") // 8 for r in rows if r.gram in (0, 1))

    written, real = [], lm.step
    monkeypatch.setattr(lm, "step", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    got = lm.score(awkward, 3, chunk_bytes=3_000, range_grams=500).collect()
    check([(r[0], r[1]) for r in awkward_rows()], got, 3)
    sent = {}
    for name, df in written:
        if name in ("counts", "followers"):
            sent.setdefault(name, []).append(df.select("gram", "part", "totals").collect())
    first, second = sent["counts"]
    assert not {r.part for r in first} & {r.part for r in second}
    assert 0.7 < numbers(first) / numbers(second) < 1.4
    assert 0 < numbers(sent["followers"][0]) < 0.7 * (numbers(first) + numbers(second))
