"""Best-fit packing with large-item matching.

Texts become token ids and are cut into pieces of at most the capacity, so a piece is one of as many kinds as the capacity has
tokens. The packing is worked out on the number of pieces of each length, which has that many rows however large the corpus is:

1. pieces of full length fill a sequence each;
2. of pieces above a third of the capacity no sequence holds three: from the longest down, each is matched with the longest
   that still fits beside it;
3. shorter pieces, from the longest down, go into the tightest gap that takes them; new sequences are opened only if none does.

The outcome is a list of moves "the pieces of length L with ranks a to b go to sequences s, s + 1, ... at offset o". Its size
depends on the capacity alone; it is broadcast and joined to the pieces, whose rank among those of their length is the number
of such pieces in earlier tasks plus their place in their own.

Null texts are empty; each text ends with the id 0, so an empty text is one piece of one token. Repeated rows are packed each by
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import slices, step
from cohortloom.llm.tokens import word_tokens

CAPACITY = 2048

Move = tuple[int, int, int, int, int]


class _Gaps:
    """Runs of sequences (first, number) with the same room left, by room."""

    def __init__(self) -> None:
        self._runs: dict[int, list[tuple[int, int]]] = {}
        self._rooms: list[int] = []

    def add(self, room: int, first: int, number: int) -> None:
        if room and number:
            if room not in self._runs:
                self._runs[room] = []
                insort(self._rooms, room)
            self._runs[room].append((first, number))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` sequences with the smallest room of at least ``size``: room, first, number."""
        at = bisect_left(self._rooms, size)
        if at == len(self._rooms):
            return None
        room = self._rooms[at]
        first, number = self._runs[room].pop()
        if number > most:
            self._runs[room].append((first + most, number - most))
            number = most
        if not self._runs[room]:
            del self._runs[room], self._rooms[at]
        return room, first, number


def moves(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Move]:
    """(length, first rank, number, first sequence, offset) for all pieces, given their number by length."""
    out: list[Move] = []
    left, used = Counter({k: v for k, v in lengths.items() if v}), Counter()
    gaps, opened = _Gaps(), 0

    def place(length: int, number: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], number, sequence, offset))
        used[length] += number
        left[length] -= number

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, min(capacity - a, a) + 1) - 1
        while at >= 0 and (not left[large[at]] or large[at] == a and left[a] == 1):
            at -= 1
        b = large[at] if at >= 0 else 0
        number = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, number, opened, 0)
        if b:
            place(b, number, opened, a)
        gaps.add(capacity - a - b, opened, number)
        opened += number
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            found = gaps.take(size, left[size])
            if found:
                room, first, number = found
                place(size, number, first, capacity - room)
                gaps.add(room - size, first, number)
                continue
            number = left[size]
            new = -(-number // (capacity // size))
            layers, more = divmod(number, new)
            for layer in range(layers):
                place(size, new, opened, layer * size)
            if more:
                place(size, more, opened, layers * size)
                gaps.add(capacity - (layers + 1) * size, opened, more)
            gaps.add(capacity - layers * size, opened + more, new - more)
            opened += new
    return out


def _piece_rows(path: str, capacity: int, keep_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = word_tokens(path), TaskContext.get().partitionId(), Counter()
        for part in slices(batches):
            at, piece, start, length, crc, rank, data = [], [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode(part["text"].to_pylist())):
                ids += b"\0\0\0\0"
                for number, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[begin : begin + 4 * capacity]
                    size = len(some) // 4
                    at.append(row), piece.append(number), start.append(begin // 4), length.append(size)
                    crc.append(zlib.crc32(some)), rank.append(seen[size]), data.append(some)
                    seen[size] += 1
            columns = {
                "doc_id": part["doc_id"].take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(at), pa.int32()),
                "rank": pa.array(rank, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(data, pa.binary())} if keep_ids else {}))

    return work


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with the task that made it and its place among that task's pieces of the same length."""
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return of.mapInArrow(_piece_rows(tokenizer, capacity, keep_ids), schema + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, **columns) -> DataFrame:
    """Every piece of every text with ``sequence_id`` and ``offset``; with ``keep_ids`` its token ids too."""
    made = step(pieces(docs, tokenizer, capacity, keep_ids=keep_ids, **columns), "pieces")
    spark = docs.sparkSession
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        [(k, a, a + n, s, o) for k, a, n, s, o in moves(lengths, capacity)],
        "of_length long, from_rank long, to_rank long, sequence long, offset long",
    )
    before = by_task.select(
        "length", "task",
        (F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    ranked = made.join(before, ["length", "task"]).withColumn("all_rank", F.col("before") + F.col("rank"))
    fits = (F.col("length") == F.col("of_length")) & (F.col("all_rank") >= F.col("from_rank")) & (F.col("all_rank") < F.col("to_rank"))
    return ranked.join(F.broadcast(plan), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("all_rank") - F.col("from_rank")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else []),
    )
