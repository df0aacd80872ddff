"""Cross-tokenizer alignment with whitespace-token anchors.

Every whole text is tokenized twice, by byte-level merges (A) and by a sentence-piece model (B), and both are checked to spell the
space and the text. Byte offsets where tokens of both end cut a text into groups; a group of p and q tokens has p + q - 1 links,
the pairs of tokens whose byte ranges overlap. An anchor is such an offset with a token that begins with a space behind it on both sides:
there the text is cut into windows, about a word each. A window's groups and links hang on its ids alone, so they are worked out once
for each pair of id tuples and remembered.

How often a pair of ids is linked is counted over the corpus, and each text asks for the counts of its own links. Texts are put
together in chunks of about ``CHUNK_BYTES``: a chunk keeps its different windows, the pairs in them, and each text as numbers of windows. It sends
its pairs with their counts once, gets back the totals, adds them up for each window and then for each text. What is sent hangs on
the different pairs of a chunk, not on its length. A pair has one row a chunk at most, however common it is.

Null and empty texts, and those that one of the tokenizers does not spell back, have no tokens: zeros, and an empty digest. Ids may be
null or repeat; each row is a text of its own. Long texts without spaces are one window, which is aligned in one walk; a text is never cut. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.llm.common import slices, step
from cohortloom.llm.tokens import _byte_letters

#: Text bytes of a chunk; a longer text is a chunk by itself.
CHUNK_BYTES = 16_000_000
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A tokenizers file with byte-level merges. If it has nothing but merges in the order of their ids, tiktoken runs them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = made["model"]["vocab"]
        self.pieces = [b""] * (max([*vocabulary.values(), *(t["id"] for t in made["added_tokens"])]) + 1)
        for token, at in vocabulary.items():
            if all(letter in byte_of for letter in token):
                self.pieces[at] = bytes(byte_of[letter] for letter in token)
        self._encode = self._ranked(made, vocabulary)
        self.keeps_bytes = self._encode is not None
        self._encode = self._encode or self._whole(path)

    def _ranked(self, made: dict, vocabulary: dict):
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        odd = made["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix")
        if odd or not plain or merged != sorted(merged) or any(not t["special"] for t in made["added_tokens"]):
            return None
        import tiktoken

        special = {t["id"] for t in made["added_tokens"]}
        ranks = {self.pieces[at]: at for at in vocabulary.values() if at not in special}
        encoder = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoder.encode_ordinary(t) for t in texts]

    def _whole(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._encode([" " + t for t in texts])


class SentencePieces:
    """A sentence-piece model, which puts the space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.pieces = []
        for at in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(at)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(at) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class _Side:
    """Lengths and first bytes of a tokenizer's pieces."""

    def __init__(self, tokenizer):
        self.encode, self.pieces = tokenizer.encode, tokenizer.pieces
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.keeps_bytes = getattr(tokenizer, "keeps_bytes", False)
        self.spaced = np.array([p.startswith(b" ") for p in self.pieces])
        self.written = {mark: np.array([b"%d" % at + mark for at in range(len(self.pieces))], object) for mark in (b",", b"|", b";")}

    def spells(self, ids, text: bytes) -> bool:
        if self.keeps_bytes:
            return int(self.lengths[ids].sum()) == len(text)  # merges of a text's own bytes
        return b"".join(map(self.pieces.__getitem__, ids)) == text


#: The ids of a window: those of A, then those of B with their highest bit set, 32 bits each.
Key = bytes
OF_B = np.uint32(1 << 31)


class Aligner:
    """Windows of texts and what is in them; both kinds of ids are kept as 32-bit numbers."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _Side(ByteLevel(a_path)), _Side(SentencePieces(b_path))

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text, None if it has none."""
        some = [t or "" for t in texts]
        for text, a, b in zip(some, self.a.encode(some), self.b.encode(some), strict=True):
            spelled, a = b" " + text.encode(), np.array(a, "<u4")
            yield (a, np.array(b, "<u4")) if text and self.a.spells(a, spelled) and self.b.spells(b, spelled) else None

    def shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``a`` and in ``b`` of the tokens that end where one of the other side does."""
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        at_a, at_b = np.zeros(a_ends[-1] + 1, bool), np.zeros(a_ends[-1] + 1, bool)
        at_a[a_ends] = at_b[b_ends] = True
        return at_b[a_ends].nonzero()[0], at_a[b_ends].nonzero()[0]

    def windows(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[Key]:
        """The text cut at its anchors: the ids of each window."""
        anchors = self.a.spaced[a[in_a[:-1] + 1]] & self.b.spaced[b[in_b[:-1] + 1]]
        a_cuts, b_cuts = (np.concatenate([[0], place[:-1][anchors] + 1, [size]]) for place, size in ((in_a, len(a)), (in_b, len(b))))
        both = np.empty(len(a) + len(b), "<u4")
        both[np.arange(len(a)) + np.repeat(b_cuts[:-1], np.diff(a_cuts))] = a
        both[np.arange(len(b)) + np.repeat(a_cuts[1:], np.diff(b_cuts))] = b | OF_B
        ids, cuts = both.tobytes(), (4 * (a_cuts + b_cuts)).tolist()
        return [ids[s:e] for s, e in zip(cuts, cuts[1:])]

    def learn(self, keys: list[Key]) -> list[tuple[bytes, bytes]]:
        """Text of the groups of each window, and its links as pairs of numbers. The windows are laid end to end: their ends are shared, so
        they do not touch each other."""
        if not keys:
            return []
        both = np.frombuffer(b"".join(keys), "<u4")
        is_b = both >= OF_B
        a, b = both[~is_b], both[is_b] ^ OF_B
        sizes = np.array(list(map(len, keys)), np.int64) // 4
        b_sizes = np.add.reduceat(is_b, np.cumsum(sizes) - sizes, dtype=np.int64)
        a_sizes = sizes - b_sizes
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        at_a, at_b = np.zeros(a_ends[-1] + 1, bool), np.zeros(a_ends[-1] + 1, bool)
        at_a[a_ends] = at_b[b_ends] = True
        # The overlap of two linked tokens ends where either of them does, and every end is that of one overlap.
        ends = (at_a | at_b).nonzero()[0]
        links = np.stack([a[(np.cumsum(at_a) - at_a)[ends]], b[(np.cumsum(at_b) - at_b)[ends]]], axis=1).tobytes()
        to = np.searchsorted(ends, a_ends[np.cumsum(a_sizes) - 1], "right") * 8
        # A group is written as its ids of A, then those of B; each id comes with the mark behind it.
        a_last, b_last = at_b[a_ends], at_a[b_ends]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        before_b = np.cumsum(np.bincount(b_group)) - np.bincount(b_group)
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_b[a_group]] = np.where(a_last, self.a.written[b"|"][a], self.a.written[b","][a])
        parts[np.arange(len(b)) + np.cumsum(np.bincount(a_group))[b_group]] = np.where(b_last, self.b.written[b";"][b], self.b.written[b","][b])
        cuts, parts = np.cumsum(a_sizes + b_sizes).tolist(), parts.tolist()
        texts = [b"".join(parts[s:e])[:-1] for s, e in zip([0, *cuts], cuts)]
        to = to.tolist()
        return [(text, links[s:e]) for text, s, e in zip(texts, [0, *to], to)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _squeezed(numbers: np.ndarray) -> bytes:
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(numbers, "<u4").tobytes(), "zstd", asbytes=True)


def _numbers(squeezed: bytes) -> np.ndarray:
    size = int.from_bytes(squeezed[:8], "little")
    return np.frombuffer(pa.decompress(squeezed[8:], 4 * size, "zstd", asbytes=True), "<u4") if size else np.zeros(0, "<u4")


class _Chunk:
    """Texts as numbers of windows; the windows of the chunk before are known from there."""

    def __init__(self, before: _Chunk | None = None):
        self.known = before.index if before else {}
        self.known_windows = before.windows if before else []
        self.index: dict[Key, int] = {}
        self.windows: list[tuple[bytes, bytes]] = []
        self.ids, self.of_texts, self.rows, self.bytes = [], [], [], 0

    def meet(self, texts: list[list[Key] | None], aligned: Aligner) -> None:
        """Takes in the windows of some texts that come next; what neither this chunk nor the one before has met is aligned, all at once."""
        new = []
        for key in set().union(*[keys for keys in texts if keys]).difference(self.index):
            old = self.known.get(key)
            if old is None:
                new.append(key)
            else:
                self.index[key] = len(self.windows)
                self.windows.append(self.known_windows[old])
        self.index.update(zip(new, range(len(self.windows), len(self.windows) + len(new)), strict=True))
        self.windows += aligned.learn(new)

    def add(self, doc_id, size: int, keys: list[Key] | None, counts: tuple[int, int, int]) -> None:
        """A text whose windows the chunk has met."""
        self.bytes += size
        self.ids.append(doc_id)
        numbers = list(map(self.index.__getitem__, keys)) if keys else []
        digest = hashlib.sha256(b";".join([self.windows[n][0] for n in numbers])).hexdigest() if keys else ""
        self.of_texts.append(np.array(numbers, "<u4"))
        self.rows.append((*counts, digest))

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        used = np.concatenate(self.of_texts)
        times = np.bincount(used, minlength=len(self.windows))
        sizes = np.array([len(links) // 8 for _, links in self.windows], np.int64)
        links = np.frombuffer(b"".join([links for _, links in self.windows]), "<u4").astype(np.int64).reshape(-1, 2)
        pairs, of_links = np.unique(links[:, 0] << 32 | links[:, 1], return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, of_links, np.repeat(times, sizes))
        n_a, n_b, n_groups, digests = zip(*self.rows, strict=True)

        def one(values, of: pa.DataType) -> pa.Array:
            return pa.array([values], pa.list_(of))

        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()), "doc_ids": one(self.ids, kind), "n_a": one(n_a, pa.int64()), "n_b": one(n_b, pa.int64()),
            "n_groups": one(n_groups, pa.int64()), "digests": one(digests, pa.string()),
            "n_windows": one([len(t) for t in self.of_texts], pa.int64()), "windows": pa.array([_squeezed(used)], pa.binary()),
            "n_links": pa.array([_squeezed(sizes)], pa.binary()), "links": pa.array([_squeezed(of_links)], pa.binary()),
            "pair_a": one(pairs >> 32, pa.int32()), "pair_b": one(pairs & 0xFFFFFFFF, pa.int32()), "pair_n": one(counts, pa.int64()),
        })


def _chunk_rows(a_path: str, b_path: str, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, number, chunk, kind = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, _Chunk(), None
        for part in slices(batches):
            texts, kind = part["text"].to_pylist(), part.schema.field("doc_id").type
            keys, counts = [], []
            for tokens in aligned.tokens(texts):
                shared = aligned.shared(*tokens) if tokens else None
                keys.append(aligned.windows(*tokens, *shared) if tokens else None)
                counts.append((len(tokens[0]), len(tokens[1]), len(shared[0])) if tokens else (0, 0, 0))
            chunk.meet(keys, aligned)
            for i, doc_id in enumerate(part["doc_id"].to_pylist()):
                size = len(texts[i] or "")
                if chunk.ids and chunk.bytes + size > most:
                    yield chunk.row(number, kind)
                    number, chunk = number + 1, _Chunk(chunk)
                    chunk.meet(keys[i:], aligned)
                chunk.add(doc_id, size, keys[i], counts[i])
        if chunk.ids:
            yield chunk.row(number, kind)

    return work


def chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The corpus tokenized twice and aligned, a row for each chunk of texts."""
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"chunk long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, n_windows array<long>, "
        "windows binary, n_links binary, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
    )
    return of.mapInArrow(_chunk_rows(a_path, b_path, chunk_bytes), schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """``a_id, b_id, n`` (links over the corpus that hold the pair) and ``best``: no id of A is linked with the id of B more often."""
    each = made.select(F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n"))).groupBy(F.col("pair_a").alias("a_id"), F.col("pair_b").alias("b_id"))
    of_b = W.partitionBy("b_id")  # as many rows as A has ids, at most
    return each.agg(F.sum("pair_n").alias("n")).withColumn("best", F.col("n") == F.max("n").over(of_b))


def _scored(kind: pa.DataType):
    def work(totals: pa.Table, made: pa.Table) -> pa.Table:
        row = made.to_pylist()[0]
        n = np.zeros(len(row["pair_a"]), np.int64)
        best = np.zeros(len(n), np.int64)
        at = totals["at"].to_numpy()
        n[at], best[at] = totals["n"].to_numpy(), totals["best"].to_numpy()
        links, sizes, windows = _numbers(row["links"]), _numbers(row["n_links"]).astype(np.int64), _numbers(row["windows"])
        ends = np.cumsum(np.array(row["n_windows"], np.int64))

        def summed(of_pairs: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(of_pairs[links])])
            last = np.cumsum(sizes)
            of_windows = running[last] - running[last - sizes]
            running = np.concatenate([[0], np.cumsum(of_windows[windows])])
            return running[ends] - running[ends - np.array(row["n_windows"], np.int64)]

        n_a, n_b, n_groups = (np.array(row[c], np.int64) for c in ("n_a", "n_b", "n_groups"))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], kind), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
            "n_best": summed(best), "count_sum": summed(n), "groups_sha256": pa.array(row["digests"]),
        })

    return work


def _arrow_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text."""
    made = step(chunks(docs, a_path, b_path, id_col, text_col, chunk_bytes), "align-chunks")
    totals = step(pair_counts(made), "align-pairs")
    asked = made.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("at", "pair"))
    told = asked.select("chunk", "at", F.col("pair.pair_a").alias("a_id"), F.col("pair.pair_b").alias("b_id")).join(totals, ["a_id", "b_id"])
    kind = docs.schema[id_col].dataType.simpleString()
    texts = made.select("chunk", "doc_ids", "n_a", "n_b", "n_groups", "digests", "n_windows", "windows", "n_links", "links", "pair_a")
    return told.select(F.col("chunk").alias("to"), "at", "n", "best").groupBy("to").cogroup(texts.groupBy("chunk")).applyInArrow(
        _scored(_arrow_kind(kind)),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )


def _group_rows(a_path: str, b_path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned_ = aligner(a_path, b_path)
        for part in slices(batches):
            at, number, starts, ends, of_a, of_b = [], [], [], [], [], []
            for row, tokens in enumerate(aligned_.tokens(part["text"].to_pylist())):
                if tokens is None:
                    continue
                a, b = tokens
                in_a, in_b = aligned_.shared(a, b)
                offsets = np.cumsum(aligned_.a.lengths[a])[in_a].tolist()
                at += [row] * len(offsets)
                number += range(len(offsets))
                starts += [0, *offsets[:-1]]
                ends += offsets
                of_a += [x.tolist() for x in np.split(a, in_a[:-1] + 1)]
                of_b += [x.tolist() for x in np.split(b, in_b[:-1] + 1)]
            ids = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part["doc_id"].take(pa.array(at, pa.int64())), "group": pa.array(number, pa.int32()), "start": pa.array(starts, pa.int64()),
                "end": pa.array(ends, pa.int64()), "a_ids": pa.array(of_a, ids), "b_ids": pa.array(of_b, ids),
            })

    return work


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group, start, end, a_ids, b_ids``: every group of every text with its byte range in the space and the text."""
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return of.mapInArrow(_group_rows(a_path, b_path), f"doc_id {kind}, group int, start long, end long, a_ids array<int>, b_ids array<int>")
