"""Similarity join of texts on word shingles with a MinHash LSH forest, verified exactly.

Equal texts form a class and are looked at once. Each class has ``TREES`` signatures of ``DEPTH`` minima of its shingle set. In a
tree the signatures, sorted, are the leaves of a prefix trie; two classes meet in it as deep as their common prefix. Meetings are
looked up at the shortest prefix that still gives the target recall at the threshold, 1 - (1 - t ^ k) ^ TREES, and those classes
are brought together, with their whole shingle sets, in blocks. There all pairs that share a prefix of that length in some tree are
verified exactly.

Classes that meet are put in one block as far as they fit in ``BLOCK_SHINGLES``; larger families are dealt over several blocks by hash
and every two blocks that share a bucket are verified against each other, so no task holds more than two blocks and no pair is ever a
row: a task sends back the number of links of each class and a spanning forest of them.

Shingles are runs of ``n`` words; a text of fewer words is one shingle. Null texts are empty; texts without words have no shingles
and no links, and equal ones form a class like any other. Repeated rows are documents of their own, in one class. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import slices, step, stored, texts_of
from cohortloom.llm.wordhash import Runs, U, Words, mix
from cohortloom.runtime import has_at_most

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9995
#: Shingles of the classes of a block, about.
BLOCK_SHINGLES = 400_000


def reach(similarity, length: int, trees: int = TREES):
    """Chance that two sets share a prefix of the length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    for length in range(depth, 0, -1):
        if reach(threshold, length, trees) >= recall:
            return length
    raise ValueError("more trees are needed for this threshold and recall")


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, in the order of the texts, and where each text's begin."""
    counts = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    edges = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(edges[-1]) - np.repeat(edges[:-1] - words.first[:-1], counts)
    return Runs(words.hash, 5).of(start, np.minimum(start + n, np.repeat(words.first[1:], counts))), edges


def _functions(number: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * number + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)).astype(np.uint32)
    return seeds[:number] | np.uint32(1), seeds[number:]


def signatures(hashes: np.ndarray, edges: np.ndarray, number: int) -> np.ndarray:
    """16 bits of the minimum under each of ``number`` hash functions; all zero for an empty set."""
    some = np.flatnonzero(np.diff(edges))
    out = np.zeros((len(edges) - 1, number), np.uint16)
    if not len(some):
        return out
    low, begin = (hashes >> U(32)).astype(np.uint32), edges[some]
    buffer = np.empty_like(low)
    for i, (a, b) in enumerate(zip(*_functions(number), strict=True)):
        np.multiply(low, a, out=buffer)
        np.add(buffer, b, out=buffer)
        out[some, i] = (np.minimum.reduceat(buffer, begin) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _signature_rows(n: int, trees: int, depth: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part["text"])
            hashes, edges = shingles(words, n)
            signed = signatures(hashes, edges, trees * depth)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": part["row"], "weight": pa.array(np.diff(edges)),
                    "signature": pa.array([x.tobytes() for x in signed], pa.binary()),
                }
            )

    return work


def _matrix(column, trees: int, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, trees, depth)


def _prefix_keys(matrix: np.ndarray, length: int) -> np.ndarray:
    """A hash of the first ``length`` minima of each tree, other for each tree."""
    key = np.repeat(np.arange(1, matrix.shape[1] + 1, dtype=np.uint64)[None, :] * U(0x9E3779B97F4A7C15), len(matrix), 0)
    for i in range(length):
        key = mix(key + matrix[:, :, i].astype(np.uint64) + U(1))
    return key


def _bucket_rows(length: int, trees: int, depth: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = _prefix_keys(_matrix(part["signature"], trees, depth), length)
                rows = np.repeat(part["row"].to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(rows)], ["bucket", "row"])

    return work


def _shingle_rows(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, edges = shingles(Words(part["text"]), n)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["row"], part["block"], part["signature"], pa.array(sets, pa.binary())], ["row", "block", "signature", "shingles"]
            )

    return work


class _Found:
    """Links of the classes of a block or of two."""

    def __init__(self, n: int):
        self.links = np.zeros(n, np.int64)
        self._root = list(range(n))
        self.pairs: list[tuple[int, int, float]] = []

    def root(self, i: int) -> int:
        while self._root[i] != i:
            self._root[i] = self._root[self._root[i]]
            i = self._root[i]
        return i

    def add(self, i: int, others: np.ndarray, similarity: np.ndarray, keep: bool) -> None:
        self.links[i] += len(others)
        self.links[others] += 1
        if keep:
            self.pairs += [(i, int(j), float(s)) for j, s in zip(others, similarity, strict=True)]
        for j in others.tolist():
            a, b = sorted((self.root(i), self.root(j)))
            self._root[b] = a


def verify(matrix: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, shortest: int, threshold: float, keep_pairs: bool = False) -> _Found:
    """All links among the classes, or with ``side`` those between its two sides, as far as the forest brings them together."""
    n = len(matrix)
    found = _Found(n)
    sizes = np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    keys = _prefix_keys(matrix, shortest)
    mark = np.zeros(len(universe), np.int32)
    candidates = []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        if side is not None:
            later = later[side[i + 1 :] != side[i]]
        candidates.append(later[(keys[later] == keys[i]).any(1)])
    for i, others in enumerate(candidates):
        if not len(others):
            continue
        mark[ids[edges[i] : edges[i + 1]]] = 1
        if len(others) * 4 > n - i:
            first = others[0]
            shared = np.add.reduceat(mark[ids[edges[first] :]], edges[first:-1] - edges[first])[others - first]
        else:
            shared = np.array([mark[ids[edges[j] : edges[j + 1]]].sum() for j in others])
        mark[ids[edges[i] : edges[i + 1]]] = 0
        similarity = shared / (sizes[i] + sizes[others] - shared)
        good = similarity >= threshold - 1e-12
        if good.any():
            found.add(i, others[good], similarity[good], keep_pairs)
    return found


def _verified_rows(trees: int, depth: int, shortest: int, threshold: float, pairs: bool):
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("block", "ascending"), ("row", "ascending")])
        row, block = table["row"].to_numpy(), table["block"].to_numpy()
        side = table["side"].to_numpy()
        out_rows, out_links, out_roots, out_pairs = [], [], [], []
        alone = bool(len(side)) and side[0] >= 0
        edges = [0, len(row)] if alone else [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(row)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            matrix = _matrix(table["signature"][a:b], trees, depth)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"][a:b]]
            found = verify(matrix, sets, side[a:b] if alone else None, shortest, threshold, pairs)
            linked = np.flatnonzero(found.links)
            out_rows.append(row[a:b][linked])
            out_links.append(found.links[linked])
            out_roots.append(row[a:b][[found.root(i) for i in linked.tolist()]] if len(linked) else row[:0])
            out_pairs += [(int(row[a + i]), int(row[a + j]), s) for i, j, s in found.pairs]
        if pairs:
            return pa.table({"row_a": pa.array([p[0] for p in out_pairs], pa.int64()), "row_b": pa.array([p[1] for p in out_pairs], pa.int64()),
                             "similarity": pa.array([p[2] for p in out_pairs], pa.float64())})
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_rows, out_links, out_roots)]
        return pa.table({"row": pa.array(flat[0]), "links": pa.array(flat[1]), "root": pa.array(flat[2])})

    return work


def _blocks(classes: DataFrame, length: int, trees: int, depth: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The block of each class that meets another, and the pairs of different blocks that share a bucket."""
    buckets = classes.filter("weight > 0").mapInArrow(_bucket_rows(length, trees, depth), "bucket long, row long")
    full = step(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).filter("n > 1").drop("n"), "buckets")
    met = step(buckets.join(full, "bucket"), "meetings")
    near = met.groupBy("row").agg(F.min("least").alias("least"))
    nearer = step(met.drop("least").join(near, "row").groupBy("bucket").agg(F.min("least").alias("least")), "bucket-families")
    family = step(
        met.drop("least").join(nearer, "bucket").groupBy("row").agg(F.min("least").alias("family"))
        .join(classes.select("row", "weight"), "row"),
        "families",
    )
    sizes = step(family.groupBy("family").agg(F.ceil(F.sum("weight") / block_shingles).cast("long").alias("parts")), "family-sizes")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    block = step(family.join(sizes, "family").select("row", "weight", F.xxhash64("family", part).alias("block")), "blocks")
    ends = met.select("bucket", "row").join(block.select("row", "block"), "row").groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"))
    several = ends.groupBy("bucket").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select("bucket")
    ends = step(ends.drop("n").join(several, "bucket"), "bucket-blocks")
    pairs = ends.alias("a").join(ends.alias("b"), F.expr("a.bucket = b.bucket AND a.block < b.block"))
    return block, step(pairs.select(F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b")).distinct(), "block-pairs")


def _verified(texts: DataFrame, classes: DataFrame, n: int, threshold: float, trees: int, depth: int, recall: float,
              block_shingles: int, pairs: bool) -> DataFrame:
    shortest = shortest_prefix(threshold, recall, trees, depth)
    block, between = _blocks(classes, shortest, trees, depth, block_shingles)
    wanted = classes.select("row", "signature").join(block, "row")
    sets = step(
        texts.select("row", "text").join(wanted, "row").select("row", "text", "block", "signature")
        .mapInArrow(_shingle_rows(n), "row long, block long, signature binary, shingles binary"),
        "shingle-sets",
    )
    total = block.agg(F.sum("weight")).first()[0] or 0
    groups = max(1, -(-total // block_shingles))
    inside = sets.withColumn("group_a", F.pmod(F.col("block"), F.lit(groups))).withColumn("group_b", F.lit(None).cast("long")).withColumn("side", F.lit(-1))
    sides = [
        between.join(sets, F.col(mine) == F.col("block")).select(
            "row", "block", "signature", "shingles", F.col("block_a").alias("group_a"), F.col("block_b").alias("group_b"), F.lit(i).alias("side")
        )
        for i, mine in enumerate(("block_a", "block_b"))
    ]
    work = _verified_rows(trees, depth, shortest, threshold, pairs)
    schema = "row_a long, row_b long, similarity double" if pairs else "row long, links long, root long"
    return step(inside.unionByName(sides[0]).unionByName(sides[1]).groupBy("group_a", "group_b").applyInArrow(work, schema), "links")


def _groups(links: DataFrame) -> DataFrame:
    """``row, group_row``: the least row that links lead to. Links are stars already, so few rounds are needed."""
    edges = step(links.select("row", "root").distinct(), "stars")
    both = edges.unionByName(edges.select(F.col("root").alias("row"), F.col("row").alias("root")))
    labels = step(both.groupBy("row").agg(F.least(F.min("row"), F.min("root")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("row").alias("root"), F.col("label").alias("other")), "root").groupBy("row").agg(F.min("other").alias("other"))
        lower = labels.join(near, "row").select("row", F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved"))
        # A label is a row too: go on to the label it has.
        jump = lower.select(F.col("row").alias("label"), F.col("label").alias("next"))
        new = step(lower.join(jump, "label").select("row", F.least("label", "next").alias("label"), (F.col("moved") | (F.col("next") < F.col("label"))).alias("moved")), "labels")
        labels = new.select("row", "label")
        if has_at_most(new.filter("moved"), 0):
            return labels.withColumnRenamed("label", "group_row")


def _classes(texts: DataFrame, n: int, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The class of every row, and the classes with signatures."""
    keyed = texts.select("row", "doc_id", F.xxhash64("text").alias("h1"), F.substring(F.md5("text"), 1, 16).alias("h2"))
    members = step(keyed, "members")
    reps = step(members.groupBy("h1", "h2").agg(F.min("row").alias("class_row"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    signed = step(texts.select("row", "text").mapInArrow(_signature_rows(n, trees, depth), "row long, weight long, signature binary"), "signatures")
    return members.join(reps, ["h1", "h2"]).drop("h1", "h2"), step(signed.join(reps.select(F.col("class_row").alias("row")), "row"), "class-signatures")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                    block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text", is_stored: bool = False) -> DataFrame:
    """A row for each document: ``row, doc_id``; its class of equal texts ``class_id`` (the least id) and ``class_size``; ``n_links``, the number
    of other texts with at least the similarity; ``group_id`` (least id) and ``group_row`` of all that links lead to."""
    texts = texts_of(stored(docs, is_stored), id_col, text_col)
    members, classes = _classes(texts, n, trees, depth)
    links = _verified(texts, classes, n, threshold, trees, depth, recall, block_shingles, False)
    counts = links.groupBy("row").agg(F.sum("links").alias("n_links")).withColumnRenamed("row", "class_row")
    groups = _groups(links).withColumnRenamed("row", "class_row")
    of_class = members.select("class_row", "class_id").distinct()
    named = step(groups.join(of_class, "class_row"), "groups")
    ids = named.groupBy("group_row").agg(F.min("class_id").alias("group_id"))
    about = step(counts.join(named.join(ids, "group_row").select("class_row", "group_row", "group_id"), "class_row"), "linked-classes")
    return members.join(about, "class_row", "left").select(
        "row", "doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("group_row", "class_row").alias("group_row"),
    )


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
          block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text", is_stored: bool = False) -> DataFrame:
    """The links themselves, between one document of each class: ``doc_id_a, doc_id_b, similarity``. As many rows as there are links."""
    texts = texts_of(stored(docs, is_stored), id_col, text_col)
    members, classes = _classes(texts, n, trees, depth)
    pairs = _verified(texts, classes, n, threshold, trees, depth, recall, block_shingles, True)
    ids = members.select("class_row", "class_id").distinct()
    first = pairs.join(ids.select(F.col("class_row").alias("row_a"), F.col("class_id").alias("doc_id_a")), "row_a")
    return first.join(ids.select(F.col("class_row").alias("row_b"), F.col("class_id").alias("doc_id_b")), "row_b").select("doc_id_a", "doc_id_b", "similarity")


def one_of_each(docs: DataFrame, is_stored: bool = False, **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the document that comes first stays, all columns as they were."""
    source = stored(docs, is_stored)
    kept = near_duplicates(source, is_stored=True, **options).filter("row = group_row").select("row")
    numbered = source.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    return numbered.join(kept, "row").select("doc.*")

