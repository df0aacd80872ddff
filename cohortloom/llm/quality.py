"""Ordinal cumulative-link regression on graded ratings of texts.

With grades 0 .. K, P(grade >= k) = sigmoid(w x - threshold_k): one weight vector shared by all grades, thresholds in ascending
order. ``x`` are hashed features of the whole text: which words and which beginnings of words occur (in lower case), and for the shapes of words (case, last
bytes, repeated at once) the share of words that have them. The fit maximises the likelihood less a quadratic penalty, on a
bounded sample of the rated texts: those ``sample_rows`` with the smallest hash of their id. Every text is scored in full.

A text's expected grade is the sum of its tail probabilities P(grade >= k); it is kept if the last of them, that of the best
grade, reaches ``least``. Null texts are empty and have no features; a null id is never rated. Of several ratings of one id the
worst counts. Repeated rows are scored alike. Without ratings nothing is rejected. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import slices, step
from cohortloom.llm.wordhash import U, Words, mix

SAMPLE_ROWS = 20_000
PENALTY = 3e-4
BITS = 18
LEAST = 0.5
#: A shape's share of the words, from 0 to 1, counts as up to this many words that occur.
SHAPE_SCALE = 8.0
#: Bytes of a word's beginning that count as a feature of their own.
PREFIX = 5
#: Entries (a feature of a text) that the fit works on at a time.
ENTRIES_AT_ONCE = 1_000_000


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: rows, features and values, in the order of the rows."""
    lower, plain = Words(column, lower=True), Words(column, hashed=False)
    n = len(plain)
    low = U((1 << bits) - 1)
    upper = np.concatenate([[0], np.cumsum((plain.data >= 65) & (plain.data <= 90))])
    letters = np.concatenate([[0], np.cumsum((lower.data >= 97) & (lower.data <= 122))])
    n_upper, n_letters = upper[plain.end] - upper[plain.start], letters[plain.end] - letters[plain.start]
    case = np.where(n_letters == 0, 3, np.where(n_upper == n_letters, 2, np.where(n_upper > 0, 1, 0))).astype(np.uint64)
    tail = plain.data[plain.end - 1].astype(np.uint64) if n else np.zeros(0, np.uint64)
    again = np.zeros(n, np.uint64)
    again[1:] = (lower.hash[1:] == lower.hash[:-1]) & (lower.doc[1:] == lower.doc[:-1])
    shapes = [mix(case + U(11)), mix(tail + U(1 << 20)), mix(again + U(1 << 30)), mix(case + (tail << U(8)) + U(1 << 40))]
    row, feature, value = [], [], []
    for number, hashes in enumerate([lower.hash, mix(lower.prefixes(PREFIX) + U(1 << 50)), *shapes]):
        keys, counts = np.unique(lower.doc.astype(np.uint64) << U(bits) | hashes & low, return_counts=True)
        row.append((keys >> U(bits)).astype(np.int64))
        feature.append((keys & low).astype(np.int64))
        value.append(np.ones(len(keys), np.float32) if number < 2 else (SHAPE_SCALE * counts / lower.counts[row[-1]]).astype(np.float32))
    row, feature, value = map(np.concatenate, (row, feature, value))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, a row for each text."""
        row, feature, value = features(column, self.bits)
        score = np.bincount(row, weights=self.weights[feature] * value, minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum())


def _minimise(value, x: np.ndarray, rounds: int, memory: int = 10, enough: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving; ``value`` gives a number and its gradient."""
    at, slope = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, factors = slope.copy(), []
        for s, y in reversed(steps):
            factors.append(_dot(s, way) / _dot(s, y))
            way -= factors[-1] * y
        if steps:
            way *= _dot(*steps[-1]) / _dot(steps[-1][1], steps[-1][1])
        for (s, y), f in zip(steps, reversed(factors), strict=True):
            way += (f - _dot(y, way) / _dot(s, y)) * s
        length, fall = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum()), _dot(slope, way)
        while True:
            there, new_slope = value(x - length * way)
            if there <= at - 1e-4 * length * fall or length < 1e-10:
                break
            length /= 2
        s, y = -length * way, new_slope - slope
        if length < 1e-10:
            return x
        if _dot(s, y) > 1e-12 * _dot(y, y):
            steps = [*steps, (s, y)][-memory:]
        done = at - there < enough * max(abs(at), 1e-3)
        x, at, slope = x + s, there, new_slope
        if done:
            return x
    return x


def fit_rows(grade: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: int, bits: int = BITS,
             penalty: float = PENALTY, rounds: int = 200, seen: int = 3) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty; rows ascend; a feature needs ``seen`` texts of the sample to get a weight."""
    size, n = 1 << bits, len(grade)
    if not n:
        return OrdinalModel(np.zeros(size), np.full(grades - 1, -30.0), bits)
    times = np.zeros(size, np.int64)
    for at in range(0, len(feature), ENTRIES_AT_ONCE):
        times += np.bincount(feature[at : at + ENTRIES_AT_ONCE], minlength=size)
    used = times >= seen
    known, number = np.flatnonzero(used), (np.cumsum(used) - 1).astype(np.int32)
    use = used[feature]
    counts = np.zeros(n, np.int64)
    for at in range(0, len(row), ENTRIES_AT_ONCE):
        some = slice(at, at + ENTRIES_AT_ONCE)
        counts += np.bincount(row[some][use[some]], minlength=n)
    del row
    value, feature = value[use], feature[use]
    column = number[feature]
    del feature, use
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    # Pieces of whole texts, of about ``ENTRIES_AT_ONCE`` entries or one text: first and last of ``full``, first and last entry.
    of_piece = np.unique((begin // ENTRIES_AT_ONCE), return_index=True)[1]
    pieces = [(i, j, begin[i], begin[j] if j < len(full) else len(column)) for i, j in zip(of_piece, [*of_piece[1:], len(full)], strict=True)]
    share = np.clip([(grade >= k).mean() for k in range(1, grades)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    # Thresholds are the first one and the logs of the gaps, so they stay in order.
    free = np.concatenate([np.zeros(len(known)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])

    def thresholds(x: np.ndarray) -> np.ndarray:
        first, gaps = x[len(known) : len(known) + 1], x[len(known) + 1 :]
        return np.concatenate([first, first + np.cumsum(np.exp(np.minimum(gaps, 10)))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights = x[: len(known)]
        score, light = np.zeros(n), weights.astype(np.float32)
        for i, j, a, b in pieces:
            score[full[i:j]] = np.add.reduceat(light[column[a:b]] * value[a:b], begin[i:j] - a, dtype=np.float64)
        tails = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds(x)[None, :], -30, 30)))
        upper = np.where(grade > 0, np.take_along_axis(tails, np.maximum(grade - 1, 0)[:, None], 1)[:, 0], 1.0)
        lower = np.where(grade < grades - 1, np.take_along_axis(tails, np.minimum(grade, grades - 2)[:, None], 1)[:, 0], 0.0)
        chance = np.maximum(upper - lower, 1e-12)
        of_edges = np.zeros(grades - 1)
        np.add.at(of_edges, np.maximum(grade - 1, 0), np.where(grade > 0, upper * (1 - upper) / chance, 0))
        np.add.at(of_edges, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -lower * (1 - lower) / chance, 0))
        later = of_edges[::-1].cumsum()[::-1] / n
        pull, pulled = (1 - upper - lower).astype(np.float32), np.zeros(len(known))
        for i, j, a, b in pieces:
            # Added one after the other, so the sums do not hang on the pieces.
            np.add.at(pulled, column[a:b].astype(np.intp), (np.repeat(pull[full[i:j]], counts[full[i:j]]) * value[a:b]).astype(float))
        of_weights = -pulled / n + penalty * weights
        gaps = np.exp(np.minimum(x[len(known) + 1 :], 10))
        return float(-np.log(chance).mean() + penalty / 2 * _dot(weights, weights)), np.concatenate([of_weights, later[:1], later[1:] * gaps])

    x = _minimise(loss, free, rounds)
    weights = np.zeros(size)
    weights[known] = x[: len(known)]
    return OrdinalModel(weights, thresholds(x), bits)


def _feature_rows(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, feature, value = features(part["text"], bits)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "grade": part["grade"],
                    "feature": pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                    "value": pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
                }
            )

    return work


def _fit_task(grades: int, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, counts, feature, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for batch in batches:
            grade.append(batch["grade"].to_numpy().astype(np.int64))
            counts.append(pa.compute.list_value_length(batch["feature"]).to_numpy().astype(np.int64))
            feature.append(pa.compute.list_flatten(batch["feature"]).to_numpy().copy())
            value.append(pa.compute.list_flatten(batch["value"]).to_numpy().copy())
        grade, counts = np.concatenate(grade), np.concatenate(counts)

        def whole(parts: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()
            return out

        # Handed over without a name here, so that the fit can let go of them.
        model = fit_rows(grade, np.repeat(np.arange(len(counts), dtype=np.int32), counts), whole(feature), whole(value), grades, bits)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype("<f8").tobytes()], "thresholds": [model.thresholds.tolist()]})

    return work


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
        bits: int = BITS) -> OrdinalModel:
    """``ratings``: ``doc_id, grade`` with grades 0 .. grades - 1."""
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = step(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "ratings")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # An id may stand on many rows; each rating is used once, with the smallest text.
    joined = texts.join(F.broadcast(sample), "doc_id")
    one = joined.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    made = step(one.mapInArrow(_feature_rows(bits), "grade int, feature array<int>, value array<float>"), "features")
    # The sample is bounded, so one task fits it; the driver sees the weights alone.
    fitted = made.coalesce(1).mapInArrow(_fit_task(grades, bits), "weights binary, thresholds array<double>").first()
    return OrdinalModel(np.frombuffer(fitted["weights"], "<f8"), np.array(fitted["thresholds"]), bits)


def _score_rows(model: OrdinalModel, least: float, columns: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tails = model.tails(part["text"])
            yield pa.RecordBatch.from_arrays(
                [*[part[c] for c in columns], pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)],
                [*columns, "expected_grade", "tail_probability", "kept"],
            )

    return work


def score(docs: DataFrame, model: OrdinalModel, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for every text."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean"
    return texts.mapInArrow(_score_rows(model, least, ["doc_id"]), schema)


def select(docs: DataFrame, model: OrdinalModel, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns as they were."""
    whole = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.struct("*").alias("doc"))
    kind = whole.schema["doc"].dataType.simpleString()
    scored = whole.mapInArrow(_score_rows(model, least, ["doc"]), f"doc {kind}, expected_grade double, tail_probability double, kept boolean")
    return scored.filter("kept").select("doc.*")


def grades_of(labels: DataFrame) -> DataFrame:
    """0: toxic; 1: of poor quality; 2: good."""
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    known = F.col("toxic").isNotNull() & F.col("quality").isNotNull()
    return labels.select("doc_id", F.when(toxic, 0).when(poor, 1).when(known, 2).alias("grade"))
