"""Packing: whole texts, gapless sequences, few of them; shards: an exact round trip."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import catalog, packing, shards
from cohortloom.llm.tokens import RankTokens, WordTokens

from .conftest import awkward_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["don't I'LL Straße ΣΑΣ İx n̈ é́a ﬁ ½ x²", "a  b", "a \n b", "a\n b c", "\n a", " a", " ", "", None, "a b\n\nc", " x   y", "<|endoftext|> x<|endoftext|>y", "a,b ,c !? ''"]


def gapless(pieces, capacity):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p[0]].append((p[1], p[2]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(40))
def test_moves_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 30, 64, 2048])
    lengths = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
    placed, rank = [], Counter()
    for length, first, number, sequence, offset in packing.moves(lengths, capacity):
        assert rank[length] == first
        rank[length] += number
        placed += [(sequence + i, offset, length) for i in range(number)]
    assert rank == Counter(lengths)
    used = gapless(placed, capacity)
    total = sum(k * n for k, n in lengths.items())
    large = sum(n for k, n in lengths.items() if 2 * k > capacity)
    # No more sequences than first-fit decreasing needs at worst.
    assert used <= 11 / 9 * max(-(-total // capacity), large) + max(2, sum(n for k, n in lengths.items() if 3 * k > capacity) / 2)


def test_large_pieces_are_matched_as_often_as_possible():
    from itertools import permutations

    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(11, 29) for _ in range(6)]
        best = min(sum(1 for _ in _pairs(order)) for order in set(permutations(sizes)))
        used = len({s + i for _, _, n, s, _ in packing.moves(Counter(sizes), 30) for i in range(n)})
        assert used == best


def _pairs(order):
    i = 0
    while i < len(order):
        i += 2 if i + 1 < len(order) and order[i] + order[i + 1] <= 30 else 1
        yield i


def test_words_are_encoded_like_whole_texts(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD
    whole, pieces = Tokenizer.from_file(PATH), WordTokens(PATH)
    assert pieces.encode(texts) == [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ranks = RankTokens(*RANKS)
    assert ranks.encode(texts) == [np.array(ranks._model.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]


def test_texts_cut_at_white_space_give_the_ids_of_whole_texts():
    ranks, rng = RankTokens(*RANKS), np.random.default_rng(5)
    marks = [" ", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "a", "word", "It's", "'ll", "7", "!?", "é", "中", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(3000)] + [m * n for m in marks for n in (1, 2, 3)]
    want = [ranks._model.encode_ordinary(t) for t in texts]
    assert ranks.encode(texts) == [np.array(ids, "<u4").tobytes() for ids in want]
    assert ranks.count(texts) == list(map(len, want))
    assert "(?!" not in ranks._cut._pat_str and RankTokens(RANKS[0], r"\s+|\S+")._cut is None


def check_packing(rows, pieces):
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            some = ids[at : at + 2048]
            want[doc_id, n, at, len(some), zlib.crc32(some.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    return gapless([(p.sequence_id, p.offset, p.length) for p in pieces], 2048), sum(p.length for p in pieces) / 2048


def test_awkward_rows(awkward):
    check_packing([(r[0], r[1]) for r in awkward_rows()], packing.pack(awkward, PATH).collect())


def test_smallest_tables(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    used, least = check_packing([(r.doc_id, r.text) for r in rows], catalog.QUERIES["op5_best_fit_packing"](spark, small).collect())
    assert used <= least * 1.02 + 1


def test_empty_tables(nothing, tmp_path):
    assert packing.pack(nothing, PATH).count() == 0
    assert shards.write_shards(nothing, RANKS, str(tmp_path)).count() == 0 and not list(tmp_path.glob("*.bin"))


@pytest.mark.parametrize("size,key", [(1, 0), (2, 5), (7, 1), (1000, 2), (4097, 3)])
def test_order_is_a_permutation_with_inverse(size, key):
    order = shards.Order(size, key)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert np.array_equal(order.sequences(slots), np.arange(size))
    if size == 1000:
        assert not np.array_equal(slots, shards.Order(size, key + 1).slots(np.arange(size)))
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.2


def test_shards_hold_the_corpus_and_can_be_read_from_any_slot(spark, awkward, tmp_path):
    length, per_shard = 64, 100
    index = shards.write_shards(awkward, RANKS, str(tmp_path), length=length, per_shard=per_shard).collect()
    assert sorted(r.slot for r in index) == list(range(len(index))) == sorted(r.seq for r in index)
    order, end = shards.Order(len(index), 20), RankTokens(*RANKS).size
    stream, read = {}, list(shards.read_slots(str(tmp_path), 0, len(index), length, per_shard))
    for r in index:
        assert order.slots(np.array([r.seq]))[0] == r.slot and r.shard == r.slot // per_shard
        assert zlib.crc32(read[r.slot].tobytes()) == r.ids_crc32 and r.position == r.slot % per_shard * length * 2
        stream[r.seq] = read[r.slot][: r.n_tokens]
    ids = np.concatenate([stream[i] for i in range(len(index))])
    ends = np.flatnonzero(ids == end)
    texts = Counter(ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *(ends[:-1] + 1)], ends))
    encoder = RankTokens(*RANKS)
    assert texts == Counter(encoder.encode([r[1] for r in awkward_rows()]))
    assert np.array_equal(next(shards.read_slots(str(tmp_path), 7, 1, length, per_shard)), read[7])
    again = shards.write_shards(awkward, RANKS, str(tmp_path), length=length, per_shard=per_shard).collect()
    assert {r.slot: r.ids_crc32 for r in again}.keys() == {r.slot for r in index}


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_shards_go_where_spark_would_put_them(spark, tmp_path, form):
    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(30)], "doc_id long, text string")
    folder = form.format(tmp_path / "shards")
    index = shards.write_shards(docs, RANKS, folder, length=64, per_shard=4).collect()
    assert list((tmp_path / "shards").glob("shard-*.bin"))
    read = list(shards.read_slots(folder, 0, len(index), 64, 4))
    crcs = {r["slot"]: r["ids_crc32"] for r in index}
    assert all(zlib.crc32(ids.tobytes()) == crcs[slot] for slot, ids in enumerate(read))
