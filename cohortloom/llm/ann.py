"""Nearest neighbours by an adaptive scan over the dimensions of rotated vectors.

Index: k-means on a bounded sample gives the lists; every vector goes to the list of its nearest centre, together with its image
under a random rotation, which spreads a vector's length evenly over the dimensions. Lists are dealt by hash into parts of bounded size.

Search: a query visits its nearest lists. In a part the rotated vectors lie in blocks of ``COLUMNS`` columns. After each block a test
compares the partial distance over j of d columns with the distance to beat, r: if partial * d / j > (r (1 + EPSILON / sqrt(j)))^2, a vector
that is truly nearer would show such a sum only with small probability, and it is abandoned. What is left at the last block is measured
on the original vectors in double precision, so every score returned is exact.

How many lists to visit is measured, not guessed: for ``CALIBRATE`` queries the true neighbours are found by a scan of all vectors, and
the smallest number of lists that holds the target share of them is taken. Data without clusters therefore visit many lists.

An index holds vectors of one length; ``nearest`` searches those of each length among their own, with an index for each, because there is no
distance between vectors of different lengths. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id. Equal distances go to the smaller id. Repeated rows are candidates of their own; only a query's own row is left out. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import step, stored

SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 8
COLUMNS, EPSILON = 16, 2.1
#: Vectors of a part, queries that meet it at a time.
PART_ROWS, PART_QUERIES = 8192, 2048
CALIBRATE, RECALL = 100, 0.97


@dataclass(frozen=True)
class Index:
    """``table``: list, part, row, vec_id, vector, rotated (little-endian doubles); the fitted centres and rotation."""

    table: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    rotation: np.ndarray


def _doubles(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f8").reshape(len(column), -1)


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(matrix, "<f8")], pa.binary())


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row, vec_id, vector`` (array of doubles) of the rows that take part, of any length."""
    read = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    return read.filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )


def lengths(points: DataFrame) -> list[int]:
    """The lengths there are, the most common first."""
    return [r["n"] for r in points.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").collect()]


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None, :] - 2 * points @ centres.T


def centres_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    out = sample[random.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(sample, out).argmin(1)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        full = counts > 0
        out[full] = sums[full] / counts[full, None]
    return out


def _index_rows(centres: np.ndarray, rotation: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = pa.compute.list_flatten(batch["vector"]).to_numpy().reshape(batch.num_rows, -1)
            nearest = _squares(points, centres).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest.astype(np.int32)), batch["row"], batch["vec_id"], _bytes(points), _bytes(points @ rotation)],
                ["list", "row", "vec_id", "vector", "rotated"],
            )

    return work


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_stored: bool = False, sample: int = SAMPLE,
          lists: int | None = None, part_rows: int = PART_ROWS, length: int | None = None) -> Index | None:
    """The index of all usable vectors of ``length`` (the most common one), fitted on at most ``sample`` of them; None if there are none."""
    points = usable(stored(vectors, is_stored), id_col, vector_col)
    if length is None:
        length = next(iter(lengths(points)), 0)
    points = points.filter(F.size("vector") == length)
    n = points.count()
    if not n:
        return None
    some = points.select("vector").sample(min(1.0, 1.2 * sample / n), 7).limit(sample).toArrow()["vector"]
    if not len(some):
        some = points.select("vector").limit(sample).toArrow()["vector"]
    fitted = pa.compute.list_flatten(some).to_numpy().reshape(len(some), -1)
    number = min(lists or max(1, round(n**0.5)), MOST_LISTS, len(fitted))
    centres = centres_of(fitted, number)
    rotation = np.linalg.qr(np.random.default_rng(3).standard_normal((fitted.shape[1],) * 2))[0]
    rows = step(points.mapInArrow(_index_rows(centres, rotation), "list int, row long, vec_id long, vector binary, rotated binary"), "vectors")
    sizes = step(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")), "list-sizes")
    table = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    return Index(table, sizes, centres, rotation)


def _near_rows(queries: np.ndarray, own: np.ndarray, k: int):
    """The k nearest vectors of each query among all that the task reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                points, row, of = _doubles(part["vector"]), part["row"].to_numpy(), part["list"].to_numpy()
                square = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * queries @ points.T
                square[own[:, None] == row[None, :]] = np.inf
                near = np.argpartition(square, min(k, len(row)) - 1, axis=1)[:, :k]
                for i, js in enumerate(near):
                    best[i] = sorted([*best[i], *((float(square[i, j]), int(row[j]), int(of[j])) for j in js if np.isfinite(square[i, j]))])[:k]
        flat = [(i, *x) for i, xs in enumerate(best) for x in xs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["query", "square", "row", "list"]
        )

    return work


def probes(index: Index, queries: DataFrame, k: int, recall: float = RECALL, sample: int = CALIBRATE) -> int:
    """The least number of lists that hold the target share of the true neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("row")).select("row", "vector").limit(sample).toArrow()
    if not some.num_rows:
        return 1
    points = _doubles(some["vector"])
    near = index.table.select("row", "list", "vector").mapInArrow(_near_rows(points, some["row"].to_numpy(), k), "query int, square double, row long, list int")
    true = near.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("square", "row"))).filter(F.col("place") <= k).select("query", "list").toArrow()
    if not true.num_rows:
        return 1
    order = _squares(points, index.centres).argsort(1).argsort(1)
    ranks = np.sort(order[true["query"].to_numpy(), true["list"].to_numpy()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _probe_rows(centres: np.ndarray, number: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argpartition(_squares(_doubles(batch["vector"]), centres), number - 1, axis=1)[:, :number]
            lists = [near[:, i].astype(np.int32) for i in range(number)]
            for each in lists:
                yield pa.RecordBatch.from_arrays([pa.array(each), *(batch[c] for c in ("row", "vec_id", "vector", "rotated"))], ["list", "row", "vec_id", "vector", "rotated"])

    return work


def scan(query: np.ndarray, turned: np.ndarray, points: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, k: int, columns: int = COLUMNS,
         epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest points that the tests leave, nearest first, ties by id."""
    d = len(query)
    partial = ((blocks[0] - turned[:columns]) ** 2).sum(1)
    left = np.arange(len(points))
    if len(points) > k:
        first = np.argpartition(partial, k - 1)[:k]
        beat = ((points[first] - query) ** 2).sum(1).max()
        for number, block in enumerate(blocks):
            if number:
                partial = partial + ((block[left] - turned[number * columns : (number + 1) * columns]) ** 2).sum(1)
            j = min(d, (number + 1) * columns)
            loose = (1 + epsilon / j**0.5) ** 2 if j < d else 1 + 1e-9
            keep = partial * (d / j) <= beat * loose + 1e-12
            left, partial = left[keep], partial[keep]
    exact = np.sqrt(((points[left] - query) ** 2).sum(1))
    order = np.lexsort((ids[left], exact))[:k]
    return left[order], exact[order]


def _scan_rows(k: int):
    def work(queries: pa.Table, table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and table.num_rows:
            points, turned = _doubles(table["vector"]), _doubles(table["rotated"])
            blocks = [np.ascontiguousarray(turned[:, a : a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]
            ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
            near, near_turned = _doubles(queries["vector"]), _doubles(queries["rotated"])
            for i, (own, query_id) in enumerate(zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), strict=True)):
                # One more than asked for: the query's own row may be among them.
                at, distance = scan(near[i], near_turned[i], points, blocks, ids, k + 1)
                keep = rows[at] != own
                out += [(own, query_id, int(r), int(v), float(s)) for r, v, s in zip(rows[at][keep][:k], ids[at][keep][:k], distance[keep][:k], strict=True)]
        kinds = {"query_row": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    return work


def search(index: Index, queries: DataFrame, k: int = 10, recall: float = RECALL, part_queries: int = PART_QUERIES) -> DataFrame:
    """The k nearest found for each of ``queries`` (rows of the index's table): ``query_id, rank, vec_id, score``."""
    number = min(probes(index, queries, k, recall), len(index.centres))
    visits = queries.select("row", "vec_id", "vector", "rotated").mapInArrow(
        _probe_rows(index.centres, number), "list int, row long, vec_id long, vector binary, rotated binary"
    )
    counts = step(queries.groupBy().count(), "query-count").first()[0]
    # A list is visited by some of the queries; each part meets them in so many turns.
    turns = max(1, -(-counts // part_queries))
    dealt = (
        visits.withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(turns)).cast("int"))
        .join(F.broadcast(index.sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    )
    table = index.table.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    found = (
        dealt.groupBy("list", "part", "turn").cogroup(table.groupBy("list", "part", "turn"))
        .applyInArrow(_scan_rows(k), "query_row long, query_id long, row long, vec_id long, score double")
    )
    place = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", is_stored: bool = False,
            recall: float = RECALL) -> DataFrame:
    """The k nearest found for each row that meets the condition ``queries`` (on ``vec_id``), among the vectors of its length."""
    source = stored(vectors, is_stored)
    out = source.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths(usable(source, id_col, vector_col)):
        index = build(source, id_col, vector_col, is_stored=True, length=length)
        out = out.unionByName(search(index, index.table.filter(queries), k, recall))
    return out
