"""The pipeline's stages against plain Python, each on what the stage before it kept, on given and on awkward documents."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortloom.llm import mixing, quality
from cohortloom.runtime import materialize

from . import test_mixing, test_substring
from .conftest import words
from .test_jaccard import brute as groups_of
from .test_packing import gapless


@pytest.fixture(scope="module", params=["given", "awkward"])
def steps(request, spark, small, awkward):
    """Input and output of every stage, by name, as frames and as rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet") if request.param == "given" else materialize(awkward, "awkward")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, small), name)
        out[name] = (docs, [r.asDict() for r in docs.collect()], after.columns, [r.asDict() for r in after.collect()])
        docs = after
    return out


def bag(rows, *columns):
    return Counter(tuple(str(r[c]) for c in columns or sorted(r)) for r in rows)


def test_columns_stay(steps):
    first = next(iter(steps.values()))[0].columns
    assert all(columns == first for name, (_, _, columns, _) in steps.items() if name != "packing")


def test_classifier(spark, small, steps):
    docs, before, _, after = steps["quality_classifier"]
    model = quality.fit(docs, quality.grades_of(spark.read.parquet(f"{small}/labels.parquet")), 3)
    kept = []
    for r in before:
        _, feature, value = quality.features(pa.array([r["text"]], pa.string()))
        score = float(np.sum(model.weights[feature] * value))
        if 1 / (1 + np.exp(-(score - model.thresholds[-1]))) >= quality.LEAST:
            kept.append(r)
    assert bag(after) == bag(kept) and kept


def test_near_duplicates(steps):
    _, before, _, after = steps["near_duplicates"]
    texts = list(dict.fromkeys(r["text"] or "" for r in before))
    _, root = groups_of(texts)
    group = dict(zip(texts, root))
    assert not bag(after) - bag(before)
    assert Counter(group[r["text"] or ""] for r in after) == dict.fromkeys(root, 1)


def test_shared_passages(steps):
    _, before, _, after = steps["substring_dedup"]
    want = Counter((r["doc_id"], n - gone, sha) for r, (n, gone, sha) in zip(before, test_substring.brute([r["text"] or "" for r in before])))
    got = Counter((r["doc_id"], len(words(r["text"])), hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in after)
    assert got == want and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)


def test_mix(steps):
    docs, before, _, after = steps["mixing"]
    planned = mixing.plan(docs).collect()
    test_mixing.check([(r["doc_id"], r["text"], r["source"]) for r in before], planned)
    taken, got = Counter(), Counter()
    for p in planned:
        taken[p["doc_id"]] += p["taken"]
    for r in after:
        got[r["doc_id"]] += len(words(r["text"]))
        assert any(words(r["text"]) == words(b["text"])[: len(words(r["text"]))] for b in before if b["doc_id"] == r["doc_id"])
    assert got == +taken


def test_packing(steps):
    _, before, _, after = steps["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            some = ids[start : start + 2048]
            want[r["doc_id"], piece, start, len(some), zlib.crc32(np.array(some, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    gapless([(r["sequence_id"], r["offset"], r["length"]) for r in after], 2048)


def test_run_is_all_stages(spark, small, request, steps):
    if "awkward" in request.node.name:
        pytest.skip("run() reads the given documents")
    got = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert bag(got, *columns) == bag(steps["packing"][3], *columns)
