"""Whole texts to token ids with a tokenizers file, piece by piece.

A tokenizer that cuts texts into words before it merges gives a word the same
ids wherever it stands. So a text is cut at places where such a tokenizer
always cuts, and the ids of pieces seen before are kept. Texts with anything
that makes a place doubtful are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import islice

import numpy as np

#: ASCII signs before which a letter's run always ends (apostrophe and underscore are not among them).
SIGNS = r""".,;:!?*#$%&|()"+\-/=<>@\[\]\\^`{}~"""
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces kept; beyond, the later half is forgotten.
KEPT = 1_000_000

_ready: dict = {}


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """The ids of pieces; what is missing is learnt."""

    def __init__(self, learn, items=()):
        super().__init__(items)
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    """encode(texts) gives an array of ids for each text, without special tokens; their strings in a text are ordinary text."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.type = np.uint16 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.code = "H" if self.type is np.uint16 else "I"
        self.kept, self.cache = kept, _Pieces(self._learn)
        self.signs = _byte_signs()
        spec = json.loads(open(path, encoding="utf-8").read())
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = spec.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [])
        if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed":
            self.kind = "words"
            self.cut = re.compile(rf"(?<=[a-zß-öø-ÿ])(?=[{SIGNS}])")
        elif not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.kind = "bytes"
            self.cut = re.compile(rf"[ \t\r\n]*[^ \t\r\n]*?[{LETTERS}](?=[{SIGNS}])|[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
            self.odd = re.compile(r"[^\S \t\r\n]")
            self.odd_ascii = "\x0b\x0c\x1c\x1d\x1e\x1f"
        else:
            self.kind = "whole"

    def pieces(self, text: str) -> list[str] | None:
        """None: the text is to be encoded whole."""
        if self.kind == "words":
            if text.isascii() or unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text:
                return self.cut.sub(" ", text.lower()).replace("\n", " ").split(" ")
            return None
        if self.kind == "bytes" and not (any(c in text for c in self.odd_ascii) if text.isascii() else self.odd.search(text)):
            return self.cut.findall(text)
        return None

    def _learn(self, piece: str) -> bytes:
        word, lead = (piece[1:], self.signs[32]) if piece[:1] == " " and self.kind == "bytes" else (piece, "")
        if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
            if not word.isascii():
                word = "".join(map(self.signs.__getitem__, word.encode()))
            return array(self.code, [t.id for t in self.model.tokenize(lead + word)]).tobytes()
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.kept:
            self.cache = _Pieces(self._learn, islice(self.cache.items(), self.kept // 2))
        get = self.cache.__getitem__
        return [np.frombuffer(self._whole(t) if (p := self.pieces(t)) is None else b"".join(map(get, p)), self.type) for t in texts]


def encoder(path: str) -> Encoder:
    """One per worker process; its pieces serve later tasks as well."""
    if path not in _ready:
        _ready[path] = Encoder(path)
    return _ready[path]
