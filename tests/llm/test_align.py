"""Alignment against whole texts walked token by token, with each tokenizer's own library."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

from cohortloom.llm import align, catalog

from .conftest import awkward_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    letters = {}
    byte = 256
    for value in range(256):  # what a byte-level vocabulary writes for a byte
        shown = chr(value) if 33 <= value < 127 or 161 <= value < 173 or 174 <= value < 256 else None
        if shown is None:
            shown, byte = chr(byte), byte + 1
        letters[shown] = value
    assert decoders.ByteLevel().decode(["Ġ", "a"]) == " a" and letters["Ġ"] == 32
    pieces = SentencePieceProcessor(model_file=B)

    def of_a(text):
        found = whole.encode(" " + text, add_special_tokens=False)
        return [(at, bytes(letters[c] for c in token)) for at, token in zip(found.ids, found.tokens, strict=True)]

    def of_b(text):
        out = []
        for at in pieces.encode([text], num_threads=1)[0]:
            piece = pieces.id_to_piece(at)
            hexed = re.fullmatch(r"<0x(..)>", piece)
            out.append((at, bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()))
        return out

    return of_a, of_b


def plain(rows, tokenizers):
    """Links by looking at all byte ranges that overlap."""
    texts, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (of(text or "") for of in tokenizers)
        spelled = b" " + (text or "").encode()
        if not text or any(b"".join(p for _, p in side) != spelled for side in (a, b)):
            texts.append((doc_id, [], [], [], []))
            continue
        ranges = []
        for side in (a, b):
            start, of = 0, []
            for at, piece in side:
                of.append((start, start + len(piece), at))
                start += len(piece)
            ranges.append(of)
        links, j = [], 0
        for s, e, at in ranges[0]:
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][0] < e:
                links.append((at, ranges[1][k][2]))
                k += 1
        counts.update(links)
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups = [[[], []] for _ in ends]
        for side in (0, 1):
            g = 0
            for s, e, at in ranges[side]:
                while ends[g] < e:
                    g += 1
                groups[g][side].append(at)
        texts.append((doc_id, ranges[0], ranges[1], groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = Counter()
    for doc_id, a, b, groups, links in texts:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out[
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ] += 1
    return out, counts, highest


def odd_rows():
    rows = [(r[0], r[1]) for r in awkward_rows() if len(r[1] or "") < 20_000]
    odd = ["<|endoftext|> <s> </s> <unk> [INST]", "under▁score", "▁", "tabs\tand\r\nlines \n\n  two  spaces ", "   leading", "日本語のテキスト 中文", "emoji 👩‍👩‍👧 ok", "\x00\x01 nul",
           "é é   nbsp　wide", "don't I'll we've", "1234567 3.14", "a" * 9000, "x y " * 400, "İstanbul ﬁ ½", "ends in space ", "{}[]()<>;;;;====>>>"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(1003, odd[3])]


@pytest.mark.parametrize("chunk_bytes", [1, 4000, align.CHUNK_BYTES])
def test_odd_rows(spark, tokenizers, chunk_bytes):
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in odd_rows()], "doc_id long, text string, n long, at int, chunk string").repartition(3)
    got = align.aligned(docs, A, B, chunk_bytes=chunk_bytes).collect()
    want, _, _ = plain(odd_rows(), tokenizers)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == want


def test_no_rows_and_no_tokens(spark, nothing):
    assert align.aligned(nothing, A, B).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, align.aligned(empty, A, B).collect()), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)], key=str)


def test_groups_and_pairs(spark, tokenizers):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    text_of, spelled_by = dict(rows), [{at: piece for _, text in rows for at, piece in of(text or "")} for of in tokenizers]
    seen = Counter()
    for r in align.groups(docs, A, B).collect():
        spelled = (b" " + text_of[r["doc_id"]].encode())[r["start"] : r["end"]]
        for ids, pieces in zip((r["a_ids"], r["b_ids"]), spelled_by, strict=True):
            assert ids and b"".join(pieces[at] for at in ids) == spelled
        seen[r["doc_id"]] += 1
    want, counts, highest = plain(rows, tokenizers)
    by_id = Counter()
    for (doc_id, _, _, n, *_), times in want.items():
        by_id[doc_id] += n * times
    assert seen == +by_id
    pairs = align.pair_counts(align.chunks(docs, A, B)).collect()
    assert {(p["a_id"], p["b_id"]): p["n"] for p in pairs} == counts
    assert all(p["best"] == (p["n"] == highest[p["b_id"]]) for p in pairs)


def test_query(spark, small, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.QUERIES["op11_tokenizer_alignment"](spark, small).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == plain(rows, tokenizers)[0]
