"""Prefix trie of conversations by truncation peeling.

A node is a sequence of first turns that some conversation begins with. From the deepest level up, the nodes that survived from below
and the conversations that end here are put together by the hash of their turns so far; a group is a node. Then the last turn is
stripped, which leaves the parent's hash, and the nodes are grouped again with what ends one level higher. Members, children, leaves,
saved tokens and the smallest member are aggregates of the same grouping, so a node is complete when it is found, and a level is
one combined shuffle, however many conversations share the node.

A conversation's path (the hash after each turn, and the words of each turn) is made once, in segments of ``SEGMENT`` turns, by a task
that reads the sorted turns as a stream. A node carries the segment it is in; when that is used up, its smallest member's segment
before is joined. So no row grows with the length of a conversation. Each level is written to the shared folder by a short job.
Equal conversations are put together first. If such a group meets no other at the end of one of its segments, it meets none below
either: it passes those levels at once and enters the peeling just above, with one child. So there are as many levels to go through as
different conversations share, rounded up to a segment. Members that end at a node are put together in order in lists of
``LIST_IDS``, which a task then reads as a stream.

Turns are ordered by number, null first; turns of equal number by a hash of role and text. Null role or text is empty. Rows without
a conversation take no part. Repeated rows are turns of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import release, step
from cohortloom.llm.sqltext import n_words
from cohortloom.runtime import materialize, scratch_path

#: Turns of a piece of a path; members of a piece of a node's list.
SEGMENT, LIST_IDS = 16, 20_000
#: Conversations of a family may start with this many turns of its first one, at most.
FAMILY, MOST_SHARED = 20, 3
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` of every turn; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), n_words(text).alias("words"))


def _own(turns_: DataFrame, skip: Column) -> DataFrame:
    return turns_.select("conv_id", F.lit(True).alias("own"), "turn", "digest", "words", skip.cast("int").alias("skip"))


def plain(turns_: DataFrame) -> DataFrame:
    """Conversations as they are."""
    return _own(turns_, F.lit(0))


def with_family_starts(turns_: DataFrame, family: int = FAMILY) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % ``family`` in place of its own first h, where h is
    crc32 of c in decimals modulo 4; c has a whole-number type."""

    def h(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)

    conv = F.col("conv_id")
    first = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = turns_.filter(conv % family == 0).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= MOST_SHARED)
    others = F.transform(F.sequence(F.lit(1 - family), F.lit(family - 1)), lambda i: F.try_add(conv, i.cast(turns_.schema["conv_id"].dataType)))
    given = heads.withColumn("other", F.explode(others)).filter(
        (F.col("other") != conv) & (F.col("other") - F.col("other") % family == conv) & (F.col("place") <= h(F.col("other")))
    )
    borrowed = given.select(
        F.col("other").alias("conv_id"), F.lit(False).alias("own"), F.col("place").cast(turns_.schema["turn"].dataType).alias("turn"),
        "digest", "words", F.lit(0).alias("skip"),
    )
    return _own(turns_, F.when(conv % family == 0, 0).otherwise(h(conv))).unionByName(borrowed)


def _paths(segment: int, kind: pa.DataType):
    """Turns sorted by conversation, borrowed ones first, become segments of paths. What was lent to a conversation that has no
    turn of its own is left out: there is no such conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, exists, met, at, keys, words, last, base, before = None, False, 0, 0, [], [], b"", b"", 0

        def made() -> pa.RecordBatch:
            convs, numbers, paths, counts, ends, bases, befores = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array(convs, kind), "keys": pa.array(paths, pa.list_(pa.binary())), "words": pa.array(counts, pa.list_(pa.int64())),
                "ends": pa.array(ends, pa.bool_()), "base": pa.array(bases, pa.binary()), "before": pa.array(befores, pa.int64()),
                "seg": pa.array(numbers, pa.int32()),
            })

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "own", "digest", "words", "skip")]
            for conv, own, digest, n, skip in zip(*columns, strict=True):
                if conv != now:
                    if exists:
                        out.append((now, at, keys, words, True, base, before))
                    now, exists, met, at, keys, words, last, base, before = conv, False, 0, 0, [], [], b"", b"", 0
                if own:
                    exists = True
                    met += 1
                    if met <= skip:
                        continue
                if len(keys) == segment:
                    out.append((now, at, keys, words, False, base, before))
                    at, base, before, keys, words = at + 1, last, before + sum(words), [], []
                last = hashlib.md5(last + digest).digest()
                keys.append(last)
                words.append(n)
            if out:
                yield made()
        if exists:
            out.append((now, at, keys, words, True, base, before))
            yield made()

    return work


def paths(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, keys, words, ends, base, before, seg``: segment ``seg`` of each conversation's path, the last one with ``ends``; ``base`` is
    the hash and ``before`` the words of all turns before it. A conversation without turns has one empty segment. Written by segment."""
    if segment <= MOST_SHARED:
        raise ValueError(f"a segment needs more than {MOST_SHARED} turns")
    kind = rows.schema["conv_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", F.col("turn").asc_nulls_first(), "digest")
    schema = f"conv_id {kind.simpleString()}, keys array<binary>, words array<bigint>, ends boolean, base binary, before bigint, seg int"
    return materialize(dealt.mapInArrow(_paths(segment, arrow), schema), "trie-paths", partition_by=["seg"])


def _grouped(level: DataFrame) -> list[Column]:
    return [
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    ]


def _leaves() -> Column:
    return F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))


def _total(numbers: Column | str) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _last_key() -> Column:
    return F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(bytearray()))


def entrances(segments: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Where groups of equal conversations, by their smallest, enter the peeling: the segment they are in with the turns up to there, and what
    lies below. And the nodes below, which no other conversation shares."""
    ended = segments.filter("ends").withColumn("total", F.col("before") + _total("words"))
    groups = ended.groupBy(_last_key().alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("total").alias("total"))
    groups = step(groups.drop("key"), "trie-groups")
    of_groups = segments.join(groups, "conv_id")
    full = of_groups.filter(F.size("keys") == segment).select(F.element_at("keys", -1).alias("key"), "conv_id", "seg")
    alone = full.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("conv_id").alias("conv_id"), F.first("seg").alias("seg")).filter("n = 1")
    tails = step(alone.groupBy("conv_id").agg(F.min("seg").alias("tail_seg")), "trie-tails")
    placed = of_groups.join(tails, "conv_id", "left")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    columns = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "keys", "words", "seg"]
    whole = placed.filter("tail_seg IS NULL AND ends").withColumns({"n_children": zero, "n_leaves": zero, "saved_tokens": zero})
    cut = F.col("total") - F.col("before") - _total(F.slice("words", 1, segment - 1))
    parted = placed.filter("seg = tail_seg").withColumns({
        "n_children": one, "n_leaves": one, "saved_tokens": (F.col("n_convs") - 1) * cut,
        "keys": F.slice("keys", 1, segment - 1), "words": F.slice("words", 1, segment - 1),
    })
    entering = materialize(whole.select(*columns).unionByName(parted.select(*columns)), "trie-entrances", partition_by=["seg"])

    below = placed.filter("seg >= tail_seg").select("*", F.posexplode("keys").alias("at", "key"))
    below = below.filter((F.col("seg") > F.col("tail_seg")) | (F.col("at") == segment - 1))
    rest = F.col("total") - F.col("before") - _total(F.slice("words", F.lit(1), F.col("at")))
    is_last = F.col("ends") & (F.col("at") == F.size("keys") - 1)
    private = below.select(
        "key", F.when(F.col("at") == 0, F.col("base")).otherwise(F.get("keys", F.col("at") - 1)).alias("parent"), "conv_id", "n_convs",
        F.when(is_last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), ((F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        (F.col("seg") * segment + F.col("at") + 1).cast("int").alias("depth"),
    )
    return entering, private


def peel(segments: DataFrame, segment: int = SEGMENT) -> DataFrame | None:
    """All nodes: ``key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens``; None if there is no conversation."""
    spark = segments.sparkSession
    entering, private = entrances(segments, segment)
    deepest = entering.agg(F.max(F.col("seg") * segment + F.size("keys"))).first()[0]
    if deepest is None:
        return None
    folder = scratch_path(spark, "trie-nodes")
    kind = segments.schema["conv_id"].dataType.simpleString()
    counts = "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    schema = f"key binary, parent binary, conv_id {kind}, {counts}, keys array<binary>, words array<bigint>"
    last = F.element_at("keys", -1)
    survivors = None
    for depth in range(deepest, 0, -1):
        seg, place = divmod(depth - 1, segment)
        columns = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "keys", "words"]
        level = entering.filter((F.col("seg") == seg) & (F.size("keys") == place + 1)).select(*columns)
        if survivors is not None:
            level = level.unionByName(survivors)
        nodes = level.withColumn("key", last).groupBy("key").agg(*_grouped(level), F.first("keys").alias("keys"), F.first("words").alias("words"))
        nodes = nodes.withColumns({
            "n_leaves": _leaves(), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("words", -1),
            "keys": F.slice("keys", 1, place), "words": F.slice("words", 1, place) if place else F.col("words"),
        })
        if place == 0 and depth > 1:
            before = segments.filter(F.col("seg") == seg - 1).select("conv_id", "keys", "words")
            nodes = nodes.drop("keys", "words").join(before, "conv_id")
        parent = last if depth > 1 else F.lit(bytearray())
        written = nodes.withColumn("parent", parent).select("key", "parent", *columns)
        written.write.parquet(f"{folder}/depth={depth}")
        survivors = spark.read.schema(schema).parquet(f"{folder}/depth={depth}").withColumn("n_children", F.lit(1).cast("long")).select(*columns)
    top = entering.filter((F.col("seg") == 0) & (F.size("keys") == 0)).select("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    if survivors is not None:
        top = top.unionByName(survivors.select(*top.columns))
    root = top.agg(*_grouped(top)).withColumns({
        "key": F.lit(bytearray()), "parent": F.lit(None).cast("binary"), "n_leaves": _leaves(), "keys": F.array().cast("array<binary>"),
        "words": F.array().cast("array<bigint>"),
    })
    root.select("key", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "keys", "words").write.parquet(f"{folder}/depth=0")
    release(spark)
    return spark.read.schema(schema + ", depth int").parquet(folder).drop("keys", "words").unionByName(private)


def _listed(kind: pa.DataType, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def made() -> pa.RecordBatch:
            text = ",".join(map(str, ids))
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], kind), "ids": pa.array([text])})

        for batch in batches:
            for k, i in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (k != key or len(ids) == most):
                    yield made()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield made()

    return work


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []

    def made() -> pa.RecordBatch:
        keys, values = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(values)})

    for batch in batches:
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        if out:
            yield made()
    if state is not None:
        out.append((key, state.hexdigest()))
        yield made()


def ending(segments: DataFrame, list_ids: int = LIST_IDS) -> DataFrame:
    """``key, ends_sha256``: the hash of the members that end at a node, in order, for nodes that have any."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    members = segments.filter("ends").select(_last_key().alias("key"), "conv_id")
    ordered = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    lists = ordered.mapInArrow(_listed(arrow, list_ids), f"key binary, first {kind}, ids string")
    return lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(rows: DataFrame, segment: int = SEGMENT, list_ids: int = LIST_IDS) -> DataFrame:
    """A row for each node of the conversations given by ``plain`` or ``with_family_starts``: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, and ``key``, the hash of its turns."""
    spark = rows.sparkSession
    segments = paths(rows, segment)
    nodes = peel(segments, segment)
    if nodes is None:
        kind = rows.schema["conv_id"].dataType.simpleString()
        return spark.createDataFrame(
            [], f"conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary"
        )
    root = nodes.filter("depth = 0").first()["conv_id"]
    ends = step(ending(segments, list_ids), "trie-ends")
    above = nodes.filter("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above_conv_id"))
    # Nodes of the first level all have the same parent, the root; the others meet theirs.
    parent_key = F.when(F.col("depth") > 1, F.col("parent"))
    whole = nodes.withColumn("parent_key", parent_key).join(above, "parent_key", "left").join(ends, "key", "left")
    kind = nodes.schema["conv_id"].dataType
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 1, F.lit(root).cast(kind)).otherwise(F.col("above_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"), "key",
    )
