"""Token ids of whole texts, memoised by chunk within a Python worker.

A byte-pair tokenizer never merges across its own pre-token borders, so the
ids of a text are those of its chunks, one after another, when each cut lies on
such a border. Two layouts are known:

* ``drop``: white space is dropped; every space or line feed is a border;
* ``prefix``: a space joins the word after it; a single space between two
  characters that are not white space is a border, before the space, and a
  single line feed between two such characters has borders on both sides.

Punctuation at the end of a chunk is cut off where the letter before it, as the
tokenizer normalizes it, does not share a pre-token with it; the tokenizer's
own parts answer that, once for each letter.

A tokenizer of any other layout encodes each text whole. Each distinct chunk
is encoded once per worker by the tokenizers library; chunks of more than
``MEMO_CHARS`` characters are not kept, and the memo is emptied when it holds
``MEMO_CHUNKS`` chunks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from operator import itemgetter

MEMO_CHUNKS, MEMO_CHARS = 1_000_000, 64
_PUNCTUATION = ".,!?;:|*$%&#"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_INNER_FEED = re.compile(r"(?<=\S)\n(?=\S)")
_DOUBLE_SPACE = re.compile(r"\s\s")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(0x100)}


def _layout(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "prefix"
    parts = pre.get("pretokenizers", [{}])
    if (
        normal
        and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert")
    ):
        return "drop"
    return "whole"


def _joined(memo: dict, chunks: list[str]) -> bytes:
    return b"".join(itemgetter("", "", *chunks)(memo))


class _Following(dict):
    """word -> ids of a space and the word."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        found = self.encoder._ids(" " + word)
        if len(word) <= MEMO_CHARS:
            self[word] = found
        return found


class Encoder(dict):
    """chunk -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.following = _Following(self)
        self.model, self.layout, self.letters = self.tokenizer.model, _layout(path), _byte_letters()
        self.borders: dict[str, bool] = {"": False}

    def __missing__(self, chunk: str) -> bytes:
        found = self._ids(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = found
        return found

    def _spaced(self, chunk: str, lead: bool) -> bytes:
        return self.following[chunk[1:]] if lead else self[chunk]

    def _ends_before_punctuation(self, letter: str) -> bool:
        """Whether a pre-token that ends in ``letter`` ends before punctuation.

        Some letters do not: one may normalize to a letter and a mark, and marks
        and punctuation share a pre-token.
        """
        found = self.borders.get(letter)
        if found is None:
            text = letter + "."
            if self.tokenizer.normalizer:
                text = self.tokenizer.normalizer.normalize_str(text)
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            found = self.borders[letter] = letter.isalpha() and pieces[-1][0] == "."
        return found

    def _ids(self, chunk: str) -> bytes:
        lead = chunk[0] == " "
        word = chunk[1:] if lead else chunk
        if word.isalpha() and max(word) < "Ā" and self.layout != "whole":
            if self.layout == "drop":
                word = word.lower()
            word = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize("Ġ" + word if lead else word)]).tobytes()
        if self.layout == "prefix" and "\n" in chunk:
            first, *lines = _INNER_FEED.split(chunk)
            if lines:
                return self["\n"].join([self._spaced(first, lead), *[self[line] for line in lines]])
        stem = chunk.rstrip(_PUNCTUATION)
        if self.layout != "whole" and len(stem) < len(chunk) and self._ends_before_punctuation(stem[-1:]):
            return self._spaced(stem, lead) + self[chunk[len(stem) :]]
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text (none for null)."""
        if not text:
            return b""
        if len(self) + len(self.following) > MEMO_CHUNKS:
            self.clear()
            self.following.clear()
            self[""] = self.following[""] = b""
        if self.layout == "drop":
            return _joined(self, text.replace("\n", " ").split(" "))
        if self.layout == "prefix":
            if _DOUBLE_SPACE.search(text) or text[0] == " " or text[-1] == " ":
                chunks = _INNER_SPACE.split(text)
            else:
                chunks = text.split(" ")
            first = self[chunks[0]] if chunks[0] else b""
            return first + _joined(self.following, chunks[1:])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
