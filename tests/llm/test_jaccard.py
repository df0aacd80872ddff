"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from cohortloom.llm import catalog, jaccard

from .conftest import awkward_rows, words


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(texts, threshold=0.8):
    """Links between different texts, and the least text number that they lead to."""
    sets = sets_of(texts)
    links, root = [set() for _ in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i].add(j), links[j].add(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, js in enumerate(links):
        for j in js:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return links, [find(i) for i in range(len(texts))]


def near_copies(n, edits, size=60, seed=0):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def check(spark, texts, **options):
    unique = list(dict.fromkeys(texts))
    links, root = brute(unique)
    least = {t: texts.index(t) for t in unique}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs, **options).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        u = unique.index(t)
        group = min(least[unique[v]] for v in range(len(unique)) if root[v] == root[u])
        assert (got[i].class_id, got[i].class_size, got[i].n_links, got[i].group_id) == (least[t], texts.count(t), len(links[u]), group), i
    return docs, unique, links


def test_family_of_near_copies_over_many_blocks(spark):
    texts = near_copies(60, 3) + near_copies(40, 1, seed=1) + [f"alone {i} " + " ".join(f"x{i}_{j}" for j in range(20)) for i in range(20)]
    random.Random(2).shuffle(texts)
    texts += texts[:30]
    docs, unique, links = check(spark, texts, block_shingles=500)
    pairs = jaccard.links(docs, block_shingles=500).collect()
    want = {frozenset((texts.index(unique[i]), texts.index(unique[j]))) for i, js in enumerate(links) for j in js}
    assert {frozenset((p.doc_id_a, p.doc_id_b)) for p in pairs} == want and len(pairs) == len(want)


def test_awkward_rows(awkward):
    rows = awkward_rows()
    got = jaccard.near_duplicates(awkward).collect()
    assert len(got) == len(rows)
    unique = list(dict.fromkeys(r[1] or "" for r in rows))
    links, _ = brute(unique)
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", []).append(r[0])
    for g in got:
        text = next(r[1] or "" for r in rows if r[0] == g.doc_id)
        if g.doc_id is not None:
            assert g.n_links == len(links[unique.index(text)]) and g.class_size == len(by_text[text])
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({g.group_row for g in got})


def test_empty_table(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0


def test_short_texts(spark):
    check(spark, ["a b c", "a b c", "a b", "", " ", "a b c ", "a  b c", "d e f g h", "d e f g h i"])


def test_close_copies_do_not_hide_a_borderline_link():
    shortest = jaccard.shortest_prefix(jaccard.THRESHOLD, jaccard.RECALL)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate([base, [np.uint64(1000 + i)]]) for i in range(40)] + [np.arange(500, 600, dtype=np.uint64), np.arange(510, 600, dtype=np.uint64)]
    matrix = np.zeros((len(sets), jaccard.TREES, jaccard.DEPTH), np.uint16)
    # The last two share a shortest prefix in one tree and no longer one.
    matrix[-2], matrix[-1] = 1, 2
    matrix[-1, 0, :shortest] = 1
    found = jaccard.verify(matrix, sets, None, shortest, threshold=jaccard.THRESHOLD, keep_pairs=True)
    assert found.links.tolist() == [39] * 40 + [1, 1] and (40, 41, 0.9) in found.pairs


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.9995), (0.5, 0.9)])
def test_shortest_prefix_reaches_the_target(threshold, recall):
    k = jaccard.shortest_prefix(threshold, recall)
    assert jaccard.reach(threshold, k) >= recall and (k == jaccard.DEPTH or jaccard.reach(threshold, k + 1) < recall)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    signed = jaccard.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 256)
    assert abs((signed[0] == signed[1]).mean() - 0.6) < 0.1


def test_smallest_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    unique = list(dict.fromkeys(r.text for r in rows))
    links, _ = brute(unique)
    got = {r.doc_id: r.n_links for r in catalog.QUERIES["op4_ngram_jaccard"](spark, small).collect()}
    assert got == {r.doc_id: len(links[unique.index(r.text)]) for r in rows}
