"""The shards hold the whole stream, in the slots of the order; texts are tokenized once."""

import zlib

import numpy as np
import pytest
import public_tokenizers

from cohortloom.llm import shards
from cohortloom.llm.tokens import rank_tokens

from .conftest import awkward_rows

VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("per_shard", [16, 100_000])
def test_stream(awkward, tmp_path, monkeypatch, per_shard):
    steps, real = [], shards.step
    monkeypatch.setattr(shards, "step", lambda df, name: steps.append((name, real(df, name))) or steps[-1][1])
    length = 64
    got = shards.write_shards(awkward, VOCABULARY, str(tmp_path / "s"), length=length, per_shard=per_shard).collect()
    texts = {}
    for r in awkward_rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    encoder = rank_tokens(*VOCABULARY)
    got.sort(key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(len(got)))
    slots = shards.Order(len(got), 20).slots(np.arange(len(got))).tolist()
    assert [r.slot for r in got] == slots and [r.shard for r in got] == [s // per_shard for s in slots]
    found = []
    for r in got:
        data = (tmp_path / "s" / f"shard-{r.shard:08d}.bin").read_bytes()[r.position : r.position + 2 * length]
        assert zlib.crc32(data) == r.ids_crc32
        found.append(np.frombuffer(data, "<u2")[: r.n_tokens])
    assert all(r.n_tokens == length for r in got[:-1])
    stream = np.concatenate(found).tolist()
    end = encoder.size
    have, now = [], []
    for x in stream:
        now.append(x)
        if x == end:
            have.append(tuple(now))
            now = []
    want = [(*np.frombuffer(ids, "<u4").tolist(), end) for some in texts.values() for ids in encoder.encode(some)]
    assert not now and sorted(have) == sorted(want)
    # Each sequence names the texts that it holds a part of, in order.
    begun = [0]
    for ids in have:
        begun.append(begun[-1] + len(ids))
    for r in got:
        a, b = r.seq * length, r.seq * length + r.n_tokens
        assert len(r.doc_ids) == sum(x < b and y > a for x, y in zip(begun[:-1], begun[1:]))
    indexes = [{r.shard for r in df.select("shard").collect()} for name, df in steps if name == "shard-index"]
    assert [name for name, _ in steps].count("ids") == 1 and len(indexes) == min(2, len({r.shard for r in got}))
    assert len(indexes) == 1 or not indexes[0] & indexes[1]


def test_empty_table(nothing):
    assert shards.write_shards(nothing, VOCABULARY).count() == 0
