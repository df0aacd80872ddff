"""Scoring texts with an n-gram model as a weighted backoff automaton.

The model: counts of all n-grams up to ``order`` of the training texts, none left out, smoothed by the number of different
tokens that follow a context (Witten and Bell's rule): those count as further observations of the next shorter context,

    p(w | c) = (n(c w) + t(c) * p(w | shorter c)) / (n(c) + t(c)),    p(w) = (n(w) + 0.5) / (N + 0.5 (V + 1))

so each distribution sums to one. As an automaton, every known context is a state; a known n-gram is an arc with the weight above;
any other token takes the failure arc, of weight t(c) / (n(c) + t(c)), to the state of the shorter context and is tried
again there. A text is read once from left to right; the state is the longest known context.

The model grows with the corpus and is never in one place. Texts are put together in chunks. Each chunk sends the hashes of its
n-grams with their counts, sorted and cut by ranges of the hash, to the ranges' tasks, which add them up and send back the totals
in the order received, marking one chunk as the n-gram's owner, and those that one chunk alone holds. This goes in ``TURNS``, each with its
share of the ranges, so that only so much of it is on disk at a time. The owners count different followers by context, and these numbers
are added up and sent back the same way; a context of one chunk alone has all its followers there and is not sent. With both, a chunk has
the part of the automaton its texts can reach, and no more.

Null texts are empty: one token, the end. A null id counts as the empty string. Repeated rows are texts of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import slices, step
from cohortloom.llm.wordhash import U, Words, mix
from cohortloom.runtime import union_all

#: Text bytes of a chunk; n-grams of an order that a range of hashes holds, about.
CHUNK_BYTES, RANGE_GRAMS = 3_000_000, 1_000_000
#: Turns in which the n-grams are sent, as a power of two: what is shuffled at a time is that part of all.
TURN_BITS = 1
ORDER = 3
_END, _START = (mix(np.array([x], np.uint64))[0] for x in (0x456E64, 0x537461))
_JOIN = U(0xA0761D6478BD642F)
SCORES = "doc_id %s, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id, folds: int = 5, fold: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunk_rows(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            text = table["text"]
            trained = sum(not held_out(d) for d in table["doc_id"].to_pylist())
            columns = {"chunk": [number], "texts": [_blob(table)], "docs": [trained], "bytes": [pa.compute.sum(pa.compute.binary_length(text)).as_py() or 0]}
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "texts" else pa.int64()) for k, v in columns.items()})

        for part in slices(batches):
            held.append(part)
            size += part["text"].nbytes
            if size >= most:
                yield chunk()
                number, held, size = number + 1, [], 0
        if held:
            yield chunk()

    return work


class _Tokens:
    """Tokens of a chunk's texts."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(blob).read_all()
        self.doc_id = table["doc_id"].combine_chunks()
        self.held_out = np.array([held_out(d) for d in self.doc_id.to_pylist()], bool)
        hashes, counts = [], []
        for part in slices(iter(table.to_batches())):
            words = Words(part["text"], lower=True)
            hashes.append(words.hash)
            counts.append(words.counts)
        counts = np.concatenate(counts)
        self.n_tokens = counts + 1
        self.last = np.cumsum(self.n_tokens) - 1
        self.first = self.last - counts
        self.tokens = np.empty(int(self.n_tokens.sum()), np.uint64)
        ends = np.zeros(len(self.tokens), bool)
        ends[self.last] = True
        self.tokens[ends], self.tokens[~ends] = _END, np.concatenate(hashes)
        self.starts = np.zeros(len(self.tokens), bool)
        self.starts[self.first] = True

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 .. order: hash of the n-gram that ends at each token, and whether it counts as trained on."""
        train = np.repeat(~self.held_out, self.n_tokens)
        gram = self.tokens
        for n in range(1, order + 1):
            if n > 1:
                before = np.empty_like(gram)
                before[1:] = gram[:-1]
                # The first token follows the start mark; contexts do not reach beyond it.
                before[self.first] = _START if n == 2 else U(n)
                gram = mix(before * _JOIN + self.tokens)
            yield gram, train & ~self.starts if n > 2 else train


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, where that begins a new value, and the distinct values; faster than ``np.unique``, whose sort is stable."""
    by = np.argsort(values)
    ordered = values[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return by, new, ordered[new]


class _Stream(_Tokens):
    """Tokens of a chunk's texts, and its distinct n-grams of each order in the order of their hashes."""

    def __init__(self, blob: bytes, order: int):
        super().__init__(blob)
        self.keys, self.at, self.seen_at = [], [], []
        for gram, _ in self.grams(order):
            by, new, keys = _sorted(gram)
            at = np.empty(len(by), np.int64)
            at[by] = np.cumsum(new) - 1
            self.keys.append(keys)
            self.seen_at.append(by[new])
            self.at.append(at)

    def followers(self, got: dict[int, np.ndarray], g: int) -> tuple[np.ndarray, int]:
        """How many different followers this chunk owns of each context with ``g`` tokens, and of the start mark."""
        at = self.seen_at[g][(got[g] & _OWNED).astype(bool)]
        inside = at[~self.starts[at]]
        return np.bincount(self.at[g - 1][inside - 1], minlength=len(self.keys[g - 1])).astype(np.uint32), len(at) - len(inside)

    def shared(self, got: dict[int, np.ndarray], g: int) -> np.ndarray:
        """Which contexts with ``g`` tokens are known to the model and held by other chunks too."""
        return (got[g - 1] >> _FLAGS > 0) & (got[g - 1] & _ALONE == 0)


def _planes(values: np.ndarray) -> bytes:
    """How many bytes, and these compressed, those of equal weight together: small numbers leave planes of zeros, and few different bytes in others."""
    data = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _values(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of hashes begin in sorted keys."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])


class _Sent:
    """Rows for the ranges' tasks: gram, part, chunk, keys, counts."""

    def __init__(self, chunk: int, bits: int):
        self._chunk, self._bits = chunk, bits
        self._rows: dict[str, list] = {"gram": [], "part": [], "keys": [], "counts": []}

    def add(self, gram: int, keys: np.ndarray, counts: np.ndarray) -> None:
        edges = _ranges(keys, self._bits)
        for part in np.flatnonzero(np.diff(edges)).tolist():
            some = slice(edges[part], edges[part + 1])
            row = (gram, part, _planes(np.diff(keys[some], prepend=U(0))), _planes(counts[some]))
            for name, value in zip(self._rows, row, strict=True):
                self._rows[name].append(value)

    def columns(self) -> dict[str, pa.Array]:
        kinds = {"gram": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        out = {k: pa.array(v, kinds[k]) for k, v in self._rows.items()}
        return out | {"chunk": pa.array([self._chunk] * len(out["gram"]), pa.int64())}


_SENT = "gram int, part int, keys binary, counts binary, chunk long"


def _gram_rows(order: int, bits: int, turn_bits: int, turn: int):
    """The n-grams whose hashes begin with the bits of ``turn``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["texts"], strict=True):
                out = _Sent(chunk, bits)
                for n, (gram, use) in enumerate(_Tokens(blob.as_buffer()).grams(order)):
                    if turn_bits:
                        now = gram >> U(64 - turn_bits) == U(turn)
                        gram, use = gram[now], use[now]
                    if len(gram):
                        by, new, keys = _sorted(gram)
                        out.add(n, keys, np.add.reduceat(use[by], np.flatnonzero(new), dtype=np.uint32))
                yield pa.RecordBatch.from_pydict(out.columns())

    return work


#: Low bits of what comes back, under the total: the chunk owns the n-gram; no other chunk has it.
_OWNED, _ALONE, _FLAGS = U(1), U(2), U(2)


def _totals(table: pa.Table) -> pa.Table:
    """For one range of hashes: each chunk's n-grams with their totals over all chunks, and the flags below these."""
    table = table.sort_by("chunk")
    deltas = [_values(x.as_py(), np.uint64) for x in table["keys"]]
    keys = np.concatenate([np.cumsum(d, dtype=np.uint64) for d in deltas])
    counts = np.concatenate([_values(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.float64)
    by, new, known = _sorted(keys)
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(new) - 1
    totals = np.bincount(at, weights=counts, minlength=len(known)).astype(np.uint64)
    both = ((totals << _FLAGS) + _ALONE * (np.bincount(at, minlength=len(known)) == 1))[at]
    both[by[new]] += _OWNED * (totals > 0)
    edges = np.cumsum([0, *map(len, deltas)])
    rows = table.num_rows
    return pa.table(
        {
            "gram": table["gram"], "part": table["part"], "chunk": table["chunk"],
            "totals": pa.array([_planes(both[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
            "distinct": pa.array([int(np.count_nonzero(totals))] + [0] * (rows - 1), pa.int64()),
            "tokens": pa.array([int(totals.sum())] + [0] * (rows - 1), pa.int64()),
        }
    )


_TOTALS = "gram int, part int, chunk long, totals binary, distinct long, tokens long"


def _received(totals: pa.Table) -> dict[int, np.ndarray]:
    """What came back, by gram, in the order of the chunk's keys."""
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for gram, part, data in zip(totals["gram"].to_pylist(), totals["part"].to_pylist(), totals["totals"].to_pylist(), strict=True):
        parts.setdefault(gram, []).append((part, data))
    return {gram: np.concatenate([_values(d, np.uint64) for _, d in sorted(rows)]) for gram, rows in parts.items()}


#: Where ``_follower_rows`` sends what follows the start mark.
_AT_START = -1


def _follower_rows(order: int, bits: int):
    def work(chunks: pa.Table, totals: pa.Table) -> pa.Table:
        stream, out = _Stream(chunks["texts"][0].as_buffer(), order), _Sent(chunks["chunk"][0].as_py(), bits)
        got = _received(totals)
        for g in range(1, order):
            followers, at_start = stream.followers(got, g)
            shared = stream.shared(got, g)
            out.add(g - 1, stream.keys[g - 1][shared], followers[shared])
            if g == 1:
                out.add(_AT_START, np.zeros(1, np.uint64), np.array([at_start], np.uint32))
        return pa.table(out.columns()).select([c.split()[0] for c in _SENT.split(", ")])

    return work


def _score_chunk(order: int, n: int, v: int, n_docs: int):
    def work(chunks: pa.Table, totals: pa.Table) -> pa.Table:
        stream = _Stream(chunks["texts"][0].as_buffer(), order)
        of_counts = pa.compute.equal(totals["kind"], 0)
        counts, follow = _received(totals.filter(of_counts)), _received(totals.filter(pa.compute.invert(of_counts)))
        seen = [(counts[g] >> _FLAGS)[stream.at[g]].astype(np.float64) for g in range(order)]
        p = (seen[0] + 0.5) / (n + 0.5 * (v + 1))
        base = np.log10(p)
        score = base.copy()
        for g in range(1, order):
            context, more = np.zeros_like(p), np.ones_like(p)
            context[1:] = seen[g - 1][:-1]
            followers, shared = stream.followers(counts, g)[0].astype(np.float64), stream.shared(counts, g)
            if g - 1 in follow:
                followers[shared] = follow[g - 1] >> _FLAGS
            more[1:] = followers[stream.at[g - 1]][:-1]
            context[stream.first] = n_docs if g == 1 else 0
            more[stream.first] = follow[_AT_START][0] >> _FLAGS if g == 1 else 1
            state = context > 0
            more[~state] = 1
            arc = state & (seen[g] > 0) if g == 1 else state & (seen[g] > 0) & ~stream.starts
            fail = np.log10(more / (context + more))
            weight = np.where(arc, seen[g] + more * p, more * p) / (context + more)
            score = np.where(arc, np.log10(weight), np.where(state, fail + score, score))
            p = np.where(state, weight, p)
        docs = len(stream.n_tokens)
        return pa.table(
            {
                "doc_id": stream.doc_id, "held_out": pa.array(stream.held_out), "n_tokens": pa.array(stream.n_tokens.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((seen[0] > 0).astype(np.int64), stream.first)),
                "train_tokens": pa.array(np.full(docs, n, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, stream.first)), "score": pa.array(np.add.reduceat(score, stream.first)),
            }
        )

    return work


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          range_grams: int = RANGE_GRAMS) -> DataFrame:
    """Log10 probability of every text, learnt from those not held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chunks = step(texts.mapInArrow(_chunk_rows(chunk_bytes), "chunk long, texts binary, docs long, bytes long"), "chunks")
    sizes = chunks.agg(F.sum("docs"), F.sum("bytes")).first()
    bits = max(0, ((sizes[1] or 0) // 6 // range_grams).bit_length())
    by_chunk = chunks.select("chunk", "texts").groupBy("chunk")
    columns = ["gram", "part", "chunk", "totals"]
    turn_bits = min(bits, TURN_BITS)

    def counted(turn: int) -> DataFrame:
        grams = chunks.select("chunk", "texts").mapInArrow(_gram_rows(order, bits, turn_bits, turn), _SENT)
        return step(grams.groupBy("gram", "part").applyInArrow(_totals, _TOTALS), "counts")

    counts = union_all([counted(turn) for turn in range(1 << turn_bits)])
    n, v = counts.filter("gram = 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    back = counts.select(*columns, F.lit(0).alias("kind"))
    if order > 1:
        sent = by_chunk.cogroup(counts.select(*columns).groupBy("chunk")).applyInArrow(_follower_rows(order, bits), _SENT)
        followers = step(sent.groupBy("gram", "part").applyInArrow(_totals, _TOTALS), "followers")
        back = back.unionByName(followers.select(*columns, F.lit(1).alias("kind")))
    work = _score_chunk(order, n or 0, v or 0, sizes[0] or 0)
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(work, SCORES % kind)
