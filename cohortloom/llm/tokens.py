"""Token ids of whole texts, with the ids of words seen before kept in the task's process.

``WordTokens`` treats the pieces between spaces by themselves, so a text's ids are those of its pieces in order. The pieces a
process has met are kept up to ``KEPT`` of them. Ids are little-endian 32-bit numbers in ``bytes``.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from array import array
from functools import cache

import numpy as np

KEPT = 400_000
#: Letters whose lower case and composed form need no look at their neighbours, then marks that end a word.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


#: The pieces of byte-level vocabularies, and how they take white space: all of a run but its last character, if something follows.
_PIECES, _RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+", r"|\s+(?!\S)|\s+"
#: Runs of two and more of what the pattern's ``\s`` stands for; Python's own is another set.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


def _cut_at_runs(text: str) -> list[str]:
    """``text`` cut before and inside long runs of white space, where ``_RUNS`` cuts; the parts need no look ahead."""
    parts, at = [], 0
    for run in _LONG_RUN.finditer(text):
        start, end = run.span()
        end -= end < len(text)
        parts += [text[at:start], text[start:end]]
        at = end
    parts.append(text[at:])
    return parts


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: its own where that prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered:
    """Ids of pieces, those met last kept in two generations of ``KEPT``; a piece that is met again moves to the younger one."""

    def __init__(self) -> None:
        self._young: dict = {}
        self._old: dict = {}

    def _new(self, piece) -> bytes:
        raise NotImplementedError

    def _learn(self, piece) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(self._young) >= KEPT:
            self._old, self._young = self._young, {}
        self._young[piece] = ids
        return ids

    def _all(self, pieces: list) -> list[bytes]:
        parts = list(map(self._young.get, pieces))
        if None in parts:
            parts = [self._young.get(w) or self._learn(w) if p is None else p for w, p in zip(pieces, parts, strict=True)]
        return parts


class WordTokens(_Remembered):
    """A tokenizers file with byte-level merges whose pre-tokenizer drops white space and lower-cases.

    Words of plain letters go to the merges directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_file(path)
        self._merges = self._whole.model
        self._letters = _byte_letters()
        self._marks: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        text = word.decode()
        simple = _SIMPLE.fullmatch(text)
        if not simple:
            return self._encode(text)
        letters, marks = simple[1].lower(), simple[2]
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self._letters)
        if marks not in self._marks:
            self._marks[marks] = self._encode(marks)
        ids = [t.id for t in self._merges.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids) + self._marks[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(self._all((text or "").encode().split())) for text in texts]


def _little(ids: array) -> bytes:
    """32-bit numbers, lowest byte first."""
    return np.frombuffer(ids, np.dtype(f"u{ids.itemsize}")).astype("<u4", copy=False).tobytes()


class RankTokens:
    """A tiktoken rank file: byte-level merges, a space belongs to the word after it. Texts go to the library whole: where many words are met
    once or twice, that is faster than to look each of them up. Looking ahead takes the library's slow matcher, nearly half of its time; with the
    usual pattern, texts are cut at long runs of white space instead."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._cut = None
        if pattern == _PIECES + _RUNS:
            self._cut = tiktoken.Encoding("cut ranks", pat_str=_PIECES + r"|\s+", mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1

    def _ids(self, text: str | None) -> list[int]:
        if not self._cut:
            return self._model.encode_ordinary(text or "")
        first, *more = map(self._cut.encode_ordinary, _cut_at_runs(text or ""))
        for ids in more:
            first += ids
        return first

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [_little(array("I", self._ids(text))) for text in texts]

    def count(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has."""
        return [len(self._ids(text)) for text in texts]


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@cache
def rank_tokens(path: str, pattern: str) -> RankTokens:
    return RankTokens(path, pattern)
