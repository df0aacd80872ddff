"""Substring deduplication by windows anchored at minimisers, which replace a relative Lempel-Ziv parse.

No factor is matched greedily against a reference: to match every text against all blocks of a corpus would grow with its square.
Instead each run of ``length`` words chooses one phrase of ``BLOCK`` words inside
it (the one with the smallest hash, the leftmost of equals), so two equal runs choose the same phrase at the same place. Every
phrase so chosen, of every text, is indexed under its hash.

A text is cut from left to right into factors: the consecutive runs that choose the same phrase, whatever other texts hold.
Phrases that the index holds once are kept. If all factors on a phrase are equal, from end to end, the factor is
a duplicate span as a whole. Where they differ, there is a boundary (an edit, the end of a passage), and the
runs of ``length`` words across it are checked one by one against the runs of the other factors on such phrases. A run that
starts in two places chooses one phrase, so both of its places are seen on the same side: nothing is lost, and no pair of
texts is ever formed.

Nulls and empty texts have no words; texts shorter than ``length`` words keep all of them; repeated rows are texts of their own,
so both lose what they share. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import slices, step, stored, texts_of
from cohortloom.llm.wordhash import Runs, U, Words, mix, whole_windows

#: Words of a run that is looked for, and of the phrase it chooses.
LENGTH = 35
BLOCK = 16


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive keys."""
    span, low = 1, keys
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - span :]) if span < width else low


def factors(words: Words, length: int, block: int):
    """Of each factor: its text, first run, number of runs, hash of its phrase, hash of all its words."""
    starts = whole_windows(words, length)
    if not len(starts):
        return None
    position = np.arange(len(words) - block + 1)
    phrases = Runs(words.hash, 1).of(position, position + block)
    keys = (phrases >> U(32) << U(32)) | position.astype(np.uint64)
    chosen = (_sliding_min(keys, length - block + 1)[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    runs = np.diff(np.append(head, len(starts)))
    first, at = starts[head], chosen[head]
    whole = Runs(words.hash, 2).of(first, first + runs - 1 + length)
    whole = mix(whole + ((at - first) * 4096 + runs).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return words.doc[first], first - words.first[words.doc[first]], runs, phrases[at], whole


def _factor_rows(length: int, block: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = factors(Words(part["text"]), length, block)
            if found is None:
                continue
            doc, first, runs, phrase, whole = found
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(phrase.view(np.int64)), pa.array(whole.view(np.int64)),
                    part["row"].take(pa.array(doc)), pa.array(first << 8 | runs),
                ],
                ["phrase", "whole", "row", "runs"],
            )

    return work


def _runs_at_boundaries(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part["text"])
            start, doc = _expand(part["runs"], words.first)
            if not len(start):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(Runs(words.hash, 3).of(start, start + length).view(np.int64)),
                    pa.array(Runs(words.hash, 4).of(start, start + length).view(np.int64)),
                    part["row"].take(pa.array(doc)), pa.array(start - words.first[doc]),
                ],
                ["run1", "run2", "row", "start"],
            )

    return work


def _expand(lists: pa.ListArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in the slice at which the listed runs (first word << 8 | number) start, and their texts."""
    doc = np.repeat(np.arange(len(lists)), pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    packed = lists.flatten().to_numpy(zero_copy_only=False)
    number = packed & 255
    start = np.repeat(first[doc] + (packed >> 8), number)
    within = np.arange(len(start)) - np.repeat(np.cumsum(number) - number, number)
    return start + within, np.repeat(doc, number)


def _kept_rows(length: int, carry: str, texts: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part["text"], hashed=False)
            start, _ = _expand(part["runs"], words.first)
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=words.n_docs)
            text, sha = [], []
            for d in range(words.n_docs):
                keep = np.flatnonzero(~gone[words.first[d] : words.first[d + 1]]) + words.first[d]
                kept = b" ".join([words.data[a:b].tobytes() for a, b in zip(words.start[keep], words.end[keep], strict=True)])
                sha.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    text.append(part["text"][d].as_py() if not removed[d] else kept.decode())
            columns = {"row": part["row"], carry: part[carry], "n_words": pa.array(words.counts), "n_removed": pa.array(removed), "kept_sha256": pa.array(sha)}
            if texts:
                columns["kept"] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return work


def duplicate_runs(texts: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``row``, ``runs`` (first word << 8 | number of runs) of all runs of ``length`` words that start in two places or more."""
    if not 1 < block < length <= 200:
        raise ValueError("length must be at most 200 words and larger than block")
    parsed = texts.select("row", "text").mapInArrow(_factor_rows(length, block), "phrase long, whole long, row long, runs long")
    shared = step(
        parsed.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("boundary"))
        .filter("n > 1").drop("n"),
        "phrases",
    )
    found = step(parsed.join(shared, "phrase").select("row", "runs", "boundary"), "factors")
    unsure = found.filter("boundary").groupBy("row").agg(F.collect_list("runs").alias("runs"))
    checked = step(
        texts.select("row", "text").join(unsure, "row")
        .mapInArrow(_runs_at_boundaries(length), "run1 long, run2 long, row long, start long"),
        "boundaries",
    )
    twice = step(checked.groupBy("run1", "run2").count().filter("count > 1").drop("count"), "repeated-runs")
    again = checked.join(twice, ["run1", "run2"]).select("row", (F.col("start") * 256 + 1).alias("runs"))
    return step(found.filter("not boundary").select("row", "runs").unionByName(again), "runs")


def _without_duplicates(texts: DataFrame, carry: str, length: int, block: int, keep_text: bool) -> DataFrame:
    spans = duplicate_runs(texts, length, block).groupBy("row").agg(F.collect_list("runs").alias("runs"))
    kind = texts.schema[carry].dataType.simpleString()
    schema = f"row long, {carry} {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return texts.join(spans, "row", "left").mapInArrow(_kept_rows(length, carry, keep_text), schema)


def remove_duplicates(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
                      is_stored: bool = False, keep_text: bool = True) -> DataFrame:
    """Every text without the words that lie in a run of ``length`` words that starts anywhere else too.

    Returns ``row, doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space) and, with ``keep_text``,
    the text ``kept``: unchanged where nothing goes, else the kept words joined by one space.
    """
    return _without_duplicates(texts_of(stored(docs, is_stored), id_col, text_col), "doc_id", length, block, keep_text)


def deduplicated(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, text_col: str = "text", is_stored: bool = False) -> DataFrame:
    """``docs`` with the text that is kept; the other columns as they were."""
    rest = [c for c in docs.columns if c != text_col]
    texts = stored(docs, is_stored).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"),
    )
    kept = _without_duplicates(texts, "rest", length, block, True)
    return kept.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.c{rest.index(c)}").alias(c) for c in docs.columns])
