"""Token shards in training order.

The texts' token ids, each text closed by an end mark, form one stream in the order of the table, cut into sequences of fixed
length; the last is filled up with end marks. A keyed Feistel network permutes the numbers 0 .. 2^2h - 1; numbers outside
0 .. n - 1 are sent through it again until they fall inside (cycle-walking), so every sequence gets a slot of its own and no
table of the order is kept anywhere. Texts are tokenized once: their ids are written compressed, with the number of ids before them in their task,
and the sums of the tasks give each its place in the stream. Slots are cut into ranges, one shard file each, written by one task in the order of the
slots with a fixed stride: slot s lies in file s // per_shard at byte (s % per_shard) * stride. A reader goes on from any slot
by seeking. The shards are written in two turns, so that only half of the ids are in a shuffle at a time; a writer that runs again writes the same bytes and puts them in place with one rename.

Null texts are empty and give their end mark only. Repeated rows each add their tokens; an empty table writes no shard and
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
from pyspark.sql.window import Window as W

from cohortloom.llm.common import slices, step, stored
from cohortloom.llm.tokens import rank_tokens
from cohortloom.llm.wordhash import U, mix
from cohortloom.runtime import opened, qualified, scratch_path, union_all

#: Tokens of a sequence; sequences of a shard.
LENGTH, PER_SHARD = 2048, 8192
#: Turns in which the shards are written.
TURNS = 2
ROUNDS = 6
ROW = "seq long, slot long, shard int, position long, n_tokens int, ids_crc32 long, doc_ids array<%s>"


class Order:
    """The keyed permutation of 0 .. size - 1 and its inverse."""

    def __init__(self, size: int, key: int, rounds: int = ROUNDS):
        self.size = size
        self._half = U(max(1, -(-max(size - 1, 1).bit_length() // 2)))
        self._low = (U(1) << self._half) - U(1)
        self._keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key % (1 << 64)))

    def _through(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self._half, x & self._low
        for key in self._keys[::-1] if back else self._keys:
            if back:
                left, right = right ^ (mix(left + key) & self._low), left
            else:
                left, right = right, left ^ (mix(right + key) & self._low)
        return left << self._half | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._through(np.asarray(numbers, np.uint64), back)
        while (outside := np.flatnonzero(out >= U(self.size))).size:
            out[outside] = self._through(out[outside], back)
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def _encoded(part: pa.RecordBatch, vocabulary: tuple[str, str]) -> tuple[list[np.ndarray], int]:
    """Ids of each text, its end mark (the first free id) behind them."""
    encoder = rank_tokens(*vocabulary)
    end = np.array([encoder.size], "<u4")
    return [np.concatenate([np.frombuffer(ids, "<u4"), end]) for ids in encoder.encode(part["text"].to_pylist())]


def _id_rows(vocabulary, kind: pa.DataType):
    """The ids of a slice of texts, compressed, with the ids before them in the task and the length of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        codec = pa.Codec("zstd", compression_level=3)
        for part in slices(batches):
            fresh = _encoded(part, vocabulary)
            ids = np.concatenate(fresh).astype("<u2" if rank_tokens(*vocabulary).size < 65_536 else "<u4")
            columns = {
                "task": pa.array([task], pa.int32()), "before": pa.array([before], pa.int64()), "n": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([codec.compress(ids.tobytes(), asbytes=True)], pa.binary()),
                "lengths": pa.array([[len(x) for x in fresh]], pa.list_(pa.int64())), "docs": pa.array([part["doc_id"].to_pylist()], pa.list_(kind)),
            }
            yield pa.RecordBatch.from_pydict(columns)
            before += len(ids)

    return work


def _part_rows(order: Order, length: int, width: int, per_shard: int, kind: pa.DataType, turns: int, turn: int):
    """Pieces of the sequences whose shards have this turn: whole ones, but for the first and last of a slice."""

    def rows(ids: np.ndarray, begin: int, firsts: np.ndarray, docs: list) -> pa.RecordBatch:
        edges = np.unique(np.concatenate([[0], np.arange(-begin % length, len(ids), length), [len(ids)]]))
        seq = (begin + edges[:-1]) // length
        slot = order.slots(seq)
        owner_from = np.searchsorted(firsts, begin + edges[:-1], "right") - 1
        owner_to = np.searchsorted(firsts, begin + edges[1:], "left")
        now = np.flatnonzero(slot // per_shard % turns == turn)
        seq, slot, owner_from, owner_to = seq[now], slot[now], owner_from[now], owner_to[now]
        starts, ends = edges[:-1][now], edges[1:][now]
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array((slot // per_shard).astype(np.int32)), "slot": pa.array(slot), "seq": pa.array(seq),
                "at": pa.array(((begin + starts) % length).astype(np.int32)),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                "doc_ids": pa.array([docs[a:b] for a, b in zip(owner_from, owner_to, strict=True)], pa.list_(kind)),
            }
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for row in range(batch.num_rows):
                begin, n = batch["base"][row].as_py() + batch["before"][row].as_py(), batch["n"][row].as_py()
                ids = np.frombuffer(codec.decompress(batch["ids"][row].as_buffer(), decompressed_size=n * width, asbytes=True), f"<u{width}")
                ends = begin + np.cumsum(batch["lengths"][row].values.to_numpy())
                yield rows(ids, begin, np.concatenate([[begin], ends[:-1]]), batch["docs"][row].as_py())

    return work


def _file(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def _write_rows(folder: str, length: int, width: int, end_mark: int, per_shard: int, kind: pa.DataType):
    """Writes the shards whose rows come in, sorted by slot and place."""
    stride = length * width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        context = TaskContext.get()
        out, shard, temporary, done = None, None, None, {"seq": [], "slot": [], "shard": [], "position": [], "n_tokens": [], "ids_crc32": [], "doc_ids": []}
        current: list | None = None

        def close_file() -> None:
            if out is not None:
                out.close()
                files.move(temporary, _file(root, shard))

        def close_sequence() -> None:
            if current is None:
                return
            slot, seq, data, docs = current
            n = len(data) // width
            data = bytes(data) + end_mark.to_bytes(width, "little") * (length - n)
            out.write(data)
            for name, value in zip(done, (seq, slot, shard, slot % per_shard * stride, n, zlib.crc32(data), docs), strict=True):
                done[name].append(value)

        def rows() -> pa.RecordBatch:
            kinds = {"shard": pa.int32(), "n_tokens": pa.int32(), "doc_ids": pa.list_(kind)}
            batch = pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in done.items()})
            for v in done.values():
                v.clear()
            return batch

        for batch in batches:
            for slot, seq, data, docs, of in zip(*(batch[c].to_pylist() for c in ("slot", "seq", "ids", "doc_ids", "shard")), strict=True):
                if current is None or current[0] != slot:
                    close_sequence()
                    current = None
                    if of != shard:
                        close_file()
                        shard, temporary = of, f"{_file(root, of)}.{context.taskAttemptId()}"
                        out = files.open_output_stream(temporary)
                    current = [slot, seq, bytearray(), []]
                current[2] += data
                current[3] += docs  # pieces end where texts or sequences do, so no text is in two pieces of a sequence
            if done["seq"]:
                yield rows()
        close_sequence()
        close_file()
        if done["seq"]:
            yield rows()

    return work


def write_shards(docs: DataFrame, vocabulary: tuple[str, str], folder: str | None = None, key: int = 20, length: int = LENGTH,
                 per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text", is_stored: bool = False) -> DataFrame:
    """Writes the shards to ``folder`` (a URI that all executors reach; default: in the shared folder) and returns a row for each
    sequence: ``seq, slot, shard, position`` (byte in the file), ``n_tokens`` (without filling), ``ids_crc32`` (of the bytes
    written), ``doc_ids`` in order."""
    spark = docs.sparkSession
    source = stored(docs, is_stored)
    texts = source.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType
    arrow_kind = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    folder = folder or scratch_path(spark, "shards")
    folder = qualified(spark, folder)  # without a scheme it is Spark's default file system, as for every other step
    files, root = opened(folder)
    files.create_dir(root)
    held = f"task int, before long, n long, ids binary, lengths array<bigint>, docs array<{kind.simpleString()}>"
    encoded = step(texts.mapInArrow(_id_rows(vocabulary, arrow_kind), held), "ids")
    counted = step(encoded.groupBy("task").agg(F.sum("n").alias("n")), "counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    size, end_mark = -(-total // length), rank_tokens(*vocabulary).size
    width = 2 if end_mark < 65_536 else 4
    shards = max(1, -(-size // per_shard))
    # One row for each task of the reading: 16 bytes for every file split.
    bases = counted.select("task", (F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    based = encoded.join(F.broadcast(bases), "task")
    order = Order(max(size, 1), key)
    turns = min(TURNS, shards)

    def written(turn: int) -> DataFrame:
        parts = based.mapInArrow(
            _part_rows(order, length, width, per_shard, arrow_kind, turns, turn),
            f"shard int, slot long, seq long, at int, ids binary, doc_ids array<{kind.simpleString()}>",
        )
        mine = (shards - turn - 1) // turns + 1
        dealt = parts.repartitionById(mine, F.floor(F.col("shard") / F.lit(turns)).cast("int")).sortWithinPartitions("slot", "at")
        rows = dealt.mapInArrow(_write_rows(folder, length, width, end_mark, per_shard, arrow_kind), ROW % kind.simpleString())
        return step(rows, "shard-index")

    return union_all([written(turn) for turn in range(turns)])


def read_slots(folder: str, slot: int, number: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """``number`` sequences from ``slot`` on, by seeking."""
    files, root = opened(folder if ":" in folder else f"file:{folder}")
    stride = length * width
    for s in range(slot, slot + number):
        with files.open_input_file(_file(root, s // per_shard)) as f:
            f.seek(s % per_shard * stride)
            yield np.frombuffer(f.read(stride), f"<u{width}")
