"""Sharding against a plain ring that is walked row by row."""

import zlib
from collections import Counter, defaultdict
from math import ceil

import pytest
import xxhash

from cohortloom.llm import catalog, ring

from .conftest import awkward_rows


def position(doc_id):
    return xxhash.xxh64(f"ring/{'' if doc_id is None else doc_id}".encode(), seed=42).intdigest() >> 1


def walk(rows, shards, points, bound):
    """Bytes each shard gets of each arc: every arc's load goes from place to place until it is in."""
    at = ring.places(shards, points)
    loads = Counter()
    for doc_id, size in rows:
        where = position(doc_id)
        arc = next((i for i, (p, _) in enumerate(at) if p >= where), 0)
        loads[arc] += size
    room = [ceil(sum(loads.values()) / shards * (1 + bound))] * shards
    got, waiting = defaultdict(Counter), [(arc, loads[arc], arc) for arc in sorted(loads)]
    while waiting:
        later = []
        for arc, left, place in waiting:
            shard = at[place][1]
            taken = min(left, room[shard])
            room[shard] -= taken
            if taken:
                got[arc][shard] += taken
            if left - taken:
                on = (place + 1) % len(at)
                while at[on][1] == shard:
                    on = (on + 1) % len(at)
                later.append((arc, left - taken, on))
        waiting = later
    return at, got


def check(rows, got, shards, points, bound):
    """``rows``: (doc_id, text) of the input; ``got``: what came out."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not got:
        return
    at, plan = walk([(g["doc_id"], g["size"]) for g in got], shards, points, bound)
    loads, largest = Counter(), max(g["size"] for g in got)
    by_arc = defaultdict(Counter)
    for g in got:
        arc = ring.home(position(g["doc_id"]), at)
        assert g["home_shard"] == at[arc][1]
        by_arc[arc][g["shard"]] += g["size"]
        loads[g["shard"]] += g["size"]
    assert max(loads.values()) <= ceil(sum(loads.values()) / shards * (1 + bound)) + largest
    for arc, shares in plan.items():
        if len(shares) == 1:
            assert by_arc[arc] == shares
        else:
            assert set(by_arc[arc]) <= set(shares)
            assert all(abs(by_arc[arc][s] - n) <= largest for s, n in shares.items())


@pytest.mark.parametrize("shards,points,range_rows", [(1, 1, 20_000), (2, 1, 2), (3, 8, 5), (16, 64, 20_000)])
def test_awkward_rows(awkward, shards, points, range_rows):
    got = ring.assign(awkward, shards, points=points, bound=0.01, range_rows=range_rows).collect()
    check([(r[0], r[1]) for r in awkward_rows()], got, shards, points, 0.01)


def test_no_rows(nothing):
    assert ring.assign(nothing).collect() == []
    assert ring.sharded(nothing).columns[-2:] == ["shard", "slot"]


def test_hot_id_is_cut(spark):
    """A third of the rows share an id and a third are equal in everything; loads stay within the bound."""
    rows = [(i if i % 3 else 7, "same" if i % 3 == 1 else f"text {i}") for i in range(3000)] + [(5, "equal")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ring.assign(docs, 8, points=128, range_rows=100).collect()
    check(rows, got, 8, 128, ring.BOUND)
    assert len({g["shard"] for g in got if g["doc_id"] == 5}) > 1
    counts = Counter(g["shard"] for g in ring.assign(docs, 8, by="rows", points=128, bound=0.0, range_rows=100).collect())
    assert max(counts.values()) <= ceil(4500 / 8)


def test_little_moves(spark):
    """From 16 to 17 shards: the new one takes its share, and little moves between old ones."""
    rows = [(i, "x" * (i * 7919 % 400)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = ({g["doc_id"]: (g["shard"], g["size"]) for g in ring.assign(docs, k).collect()} for k in (16, 17))
    total = sum(size for _, size in old.values())
    to_new = sum(size for i, (s, size) in old.items() if new[i][0] == 16)
    between = sum(size for i, (s, size) in old.items() if new[i][0] not in (16, s))
    assert to_new == pytest.approx(total / 17, rel=0.02)
    assert between < 0.05 * total


def test_query(spark, small):
    got = [r.asDict() for r in catalog.QUERIES["op13_sharding"](spark, small).collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    check([tuple(r) for r in docs], got, 16, ring.POINTS, ring.BOUND)
    assert {(g["law"], g["grown_shard"]) for g in got} == {("bytes", None)}
    again = catalog.QUERIES["op13_sharding"](spark, small).collect()
    assert sorted((g["doc_id"], g["shard"]) for g in got) == sorted((g["doc_id"], g["shard"]) for g in again)


def test_written_shards(spark, awkward, tmp_path):
    back = ring.write(awkward, str(tmp_path / "shards"), rows_per_file=2, shards=3, points=16)
    rows = back.collect()
    assert Counter(r["text"] for r in rows) == Counter(r[1] for r in awkward_rows())
    assert {"row", "size", "key", "part", "words", "kept", "shard", "slot"} <= set(back.columns)
    assert all(r["file"] == r["slot"] // 2 for r in rows)
