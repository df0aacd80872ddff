"""Substring deduplication against counting all windows."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from cohortloom.llm import catalog, substring
from cohortloom.llm.wordhash import Words

from .conftest import awkward_rows, words


def brute(texts, length=35):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_awkward_rows(spark, awkward):
    got = substring.remove_duplicates(awkward).collect()
    rows = awkward_rows()
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == want


@pytest.mark.parametrize("length,block", [(5, 3), (8, 2), (12, 11)])
def test_few_different_words(spark, length, block):
    import random

    random.seed(length)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in substring.remove_duplicates(docs, length, block).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_text_is_unchanged_where_nothing_goes_and_columns_stay(awkward):
    out = substring.deduplicated(awkward)
    assert out.columns == awkward.columns
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[3].text == " \n\t " and by_id[1].text == "" and by_id[15].text == "" and by_id[13].text == dict((r[0], r[1]) for r in awkward_rows())[13]
    assert by_id[7].row == 7 and by_id[7].words == ["w"] and by_id[7].source == "c" and by_id[1].source is None


def test_empty_table(nothing):
    assert substring.remove_duplicates(nothing).count() == 0


def test_smallest_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]))}
    got = catalog.QUERIES["op6_substring_dedup"](spark, small).collect()
    assert {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in got} == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é \n\t\x0b,", max_size=30)), max_size=6))
def test_words_and_their_hashes(texts):
    got = Words(pa.array(texts, pa.string()))
    want = [(d, w) for d, t in enumerate(texts) for w in words(t)]
    assert [(int(d), got.bytes_of(i).decode()) for i, d in enumerate(got.doc)] == want
    assert len(set(got.hash.tolist())) == len({w for _, w in want})
    assert got.counts.tolist() == [len(words(t)) for t in texts]
    assert np.array_equal(got.first[1:] - got.first[:-1], got.counts)
