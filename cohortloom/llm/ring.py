"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``POINTS`` places of a ring, found by hashing its number; a row belongs to the first place clockwise of the
hash of its id. No shard takes more than (1 + ``BOUND``) times the mean: the rows for which a full shard has no room go on clockwise
to the next place of another shard, and so on until they are in. Loads are bytes of text (plus one a row), or rows.

Which shard an arc of the ring ends up in is worked out on the sums of the arcs, whose number is that of the places: runs of load
ask place after place, in waves, and a shard that fills up in a wave cuts the run it meets then. It fills up once, so there are
at most as many cuts as shards. Only rows of arcs that are cut need an order; they get it by prefix sums over ranges of a second hash. A row
belongs to the run in which its first byte falls, so a shard holds at most its bound and one row. Slots are prefix counts over ranges as well.

With one more shard, rows move to it from all others; what moves between old shards is the load that overflowed before or
overflows now, small because many places even the arcs out (3 % of the mean at 1,024 places).

Null ids hash like the empty text; null texts have one byte. Repeated rows, and rows that share an id, are placed each by itself, so a
hot id is cut like any arc; equal rows are told apart by their row number. An empty table gives an empty result; other
columns are not read by ``assign`` and carried along by ``sharded`` (which names its own ``shard`` and ``slot``: it raises if taken).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import step, stored

SHARDS = 16
#: Places of a shard on the ring, and how far its load may go beyond the mean.
POINTS, BOUND = 1024, 0.001
#: Rows of a range, about.
RANGE_ROWS = 20_000
#: Positions on the ring have so many bits.
BITS = 63

Run = tuple[int, int, int, int]


def places(shards: int, points: int = POINTS, seed: str = "ring") -> list[tuple[int, int]]:
    """(position, shard) of every place in order. A further shard only adds its own."""

    def at(shard: int, point: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{point}".encode()).digest()[:8], "big") >> (64 - BITS)

    return sorted((at(s, p), s) for s in range(shards) for p in range(points))


def runs(loads: dict[int, int], owners: list[int], capacity: int) -> list[Run]:
    """(arc, from, to, shard): which part of each arc's load goes where, if shard ``owners[a]`` stands at the end of arc ``a``.

    All capacities together must hold all loads.
    """
    n = len(owners)
    following = [0] * n
    for at in range(2 * n - 1, -1, -1):  # the next place of another shard
        after = (at + 1) % n
        following[at % n] = after if owners[after] != owners[at % n] else following[after]
    room = [capacity] * (max(owners) + 1)
    out: list[Run] = []
    wave = [(arc, 0, load, arc) for arc, load in sorted(loads.items()) if load]
    while wave:
        waiting = []
        for arc, start, end, at in wave:
            shard = owners[at]
            taken = min(end - start, room[shard])
            if taken:
                out.append((arc, start, start + taken, shard))
                room[shard] -= taken
            if start + taken < end:
                waiting.append((arc, start + taken, end, following[at]))
        wave = waiting
    return out


def _ring_table(spark, ring: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """Arcs as ranges of positions, each listed under every bucket (leading bits) it touches, and the number of leading bits."""
    bits = max(1, len(ring).bit_length())
    low = BITS - bits
    rows = []
    start = 0
    for arc, (end, _) in enumerate([*ring, (2**BITS - 1, 0)]):  # behind the last place the ring begins anew
        if start <= end:
            rows += [(bucket, start, end, arc % len(ring)) for bucket in range(start >> low, (end >> low) + 1)]
        start = end + 1
    return spark.createDataFrame(rows, "bucket long, arc_from long, arc_to long, arc int"), low


def _ranged(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """With ``part``: the range of the 63-bit number ``spin``, and rows of a ``key`` and ``part`` about ``RANGE_ROWS``."""
    return rows.withColumn("part", F.floor(F.col("spin").cast("double") / F.lit(2.0**BITS) * parts).cast("int"))


def _before(rows: DataFrame, key: str, weight) -> DataFrame:
    """``before``: the weight of all rows of the same key with a smaller (part, spin, row). Ranges of a key are summed first."""
    sums = rows.groupBy(F.col(key).alias("of_key"), F.col("part").alias("of_part")).agg(F.sum(weight).alias("sum"))
    earlier = W.partitionBy("of_key").orderBy("of_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("of_key", "of_part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy(key, "part").orderBy("spin", "row").rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    met = own.join(sums, (F.col(key) == F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return met.withColumn("before", F.col("base") + F.col("own")).drop("of_key", "of_part", "base", "own")


def assign(docs: DataFrame, shards: int = SHARDS, by: str = "bytes", points: int = POINTS, bound: float = BOUND, seed: str = "ring",
           id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS, is_stored: bool = False) -> DataFrame:
    """``row, doc_id, size, text_crc32, home_shard, shard, slot`` for every row. ``by`` is what is balanced: "bytes" or "rows"."""
    if by not in ("bytes", "rows"):
        raise ValueError("by must be bytes or rows")
    spark = docs.sparkSession
    ring = places(shards, points, seed)
    owners = [shard for _, shard in ring]
    arcs, low = _ring_table(spark, ring)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stored(docs, is_stored).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    hashed = rows.withColumns({
        "position": F.shiftrightunsigned(F.xxhash64(name), 64 - BITS),
        "spin": F.shiftrightunsigned(F.xxhash64(name, F.col("text_crc32"), F.col("size"), F.col("row")), 64 - BITS),
    }).withColumn("bucket", F.shiftright("position", low))
    found = hashed.join(F.broadcast(arcs), "bucket").filter("position BETWEEN arc_from AND arc_to")
    keyed = step(found.select("row", "doc_id", "size", "text_crc32", "spin", "arc"), "ring-rows")

    weight = F.col("size") if by == "bytes" else F.lit(1).cast("long")
    sums = {r["arc"]: r for r in keyed.groupBy("arc").agg(F.sum(weight).alias("load"), F.count(F.lit(1)).alias("n")).collect()}
    loads = {arc: r["load"] for arc, r in sums.items()}
    n_rows, total = sum(r["n"] for r in sums.values()), sum(loads.values())
    capacity = ceil(total / shards * (1 + bound))
    placing = runs(loads, owners, capacity)
    table = spark.createDataFrame(
        [(arc, start, end, shard, owners[arc], end - start < loads[arc]) for arc, start, end, shard in placing],
        "arc int, run_from long, run_to long, shard int, home_shard int, cut boolean",
    )
    whole = keyed.join(F.broadcast(table.filter("NOT cut")), "arc")
    cut_rows = sum(sums[arc]["n"] for arc in {r[0] for r in placing if r[2] - r[1] < loads[r[0]]})
    cut_arcs = table.filter("cut").select("arc").distinct()
    cut = _ranged(keyed.join(F.broadcast(cut_arcs), "arc"), "arc", max(1, -(-cut_rows // range_rows)))
    cut = _before(cut, "arc", weight).join(F.broadcast(table.filter("cut")), "arc").filter("before >= run_from AND before < run_to")
    columns = ["row", "doc_id", "size", "text_crc32", "spin", "home_shard", "shard"]
    placed = whole.select(*columns).unionByName(cut.select(*columns))
    slotted = _before(_ranged(placed, "shard", max(1, -(-n_rows // (shards * range_rows)))), "shard", F.lit(1).cast("long"))
    return slotted.select(*[c for c in columns if c != "spin"], F.col("before").alias("slot"))


def sharded(docs: DataFrame, is_stored: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``."""
    taken = {"shard", "slot"} & set(docs.columns)
    if taken:
        raise ValueError(f"the table has {sorted(taken)} already")
    source = stored(docs, is_stored)
    where = assign(source, is_stored=True, **options).select(F.col("row").alias("shard_row"), "shard", "slot")
    numbered = source.select(F.monotonically_increasing_id().alias("shard_row"), F.struct("*").alias("doc"))
    met = numbered.join(where, "shard_row")
    return met.select(*[F.col("doc")[c].alias(c) for c in docs.columns], "shard", "slot")


def write(docs: DataFrame, folder: str, rows_per_file: int = 100_000, **options) -> DataFrame:
    """Writes a folder for each shard, its files being ranges of ``rows_per_file`` slots; returns the table as written."""
    dealt = sharded(docs, **options).withColumn("file", F.floor(F.col("slot") / rows_per_file).cast("int"))
    spread = dealt.repartition(F.col("shard"), F.col("file")).sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard", "file").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def home(position: int, ring: list[tuple[int, int]]) -> int:
    """The arc of a position: that of the first place at or behind it."""
    return bisect_left(ring, (position, -1)) % len(ring)
