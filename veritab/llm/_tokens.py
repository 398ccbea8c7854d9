"""Token ids of whole texts, by the tokenizers library's models, with a cache of pieces.

A library encode of running text costs tens of microseconds a word, most of it for words seen
before. Text of the two public layouts below falls into pieces at white space that no pre-token
crosses, so a piece's ids can be kept: a piece is cut into pre-tokens by the layout's own pattern
and each goes through the library's BPE model once. Most pieces are one word of Latin letters, with
closing marks or none, and need no pattern to be cut. Where that does not hold (runs of white space
around a space, separator controls, special tokens' strings, any other layout), the library encodes
the whole text. Both caches stop growing at a limit, so memory is bounded.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

PIECES, TOKENS = 300_000, 50_000
U4 = np.dtype("<u4")

# The pre-token patterns of the two layouts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters alone (all of them in composed form), and marks that form one pre-token in both layouts.
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch


def byte_table() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: visible Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class Encoder:
    """encode(text): the ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        layout = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in layout["added_tokens"]]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.packed = [struct.pack("<I", i) for i in range(self.vocab_size)]
        self.table, pre = byte_table(), layout["pre_tokenizer"] or {}
        self.tokens = _Cache(self._ids, TOKENS)
        self.kind = ""
        if not layout["normalizer"] and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind, pattern = "byte", regex.compile(BYTE_LEVEL)
            self.pieces = _Cache(lambda p: self._simple(p, " ") or self._joined(pattern.findall(" " + p)), limit)
            self.first = lambda p: self._joined(pattern.findall(p))
        elif [n["type"] for n in (layout["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            splits = pre.get("pretokenizers", [])
            if splits and splits[0].get("pattern") == {"Regex": WORD_LEVEL} and splits[0]["invert"]:
                self.kind, pattern = "word", regex.compile(WORD_LEVEL)
                self.pieces = _Cache(lambda p: self._simple(p.lower(), "") or self._joined(pattern.findall(self._folded(p))), limit)
        self.unsafe = re.compile(r"\s (?:\s|$)")

    def _ids(self, token: str) -> bytes:
        mapped = token.encode().decode("latin-1").translate(self.table)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])

    def _simple(self, piece: str, before: str) -> bytes | None:
        """The ids of a word with closing marks; None for other pieces."""
        found = SIMPLE(piece)
        if not found:
            return None
        word, marks = found.groups()
        return self._ids(before + word) + (self.tokens[marks] if marks else b"")

    def _joined(self, tokens: list[str]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, tokens))

    @staticmethod
    def _folded(piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", piece))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind and not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.special)):
            if self.kind == "word":
                return b"".join(map(self.pieces.__getitem__, text.split()))
            if not self.unsafe.search(text):
                head, *rest = text.split(" ")
                return self.first(head) + b"".join(map(self.pieces.__getitem__, rest))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, U4).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file: Python workers are kept, and so are its caches."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
