"""Pre-tokens of public tokenizer files, cut once and encoded once.

A tokenizer of the tokenizers library encodes every pre-token by itself, so the ids of a text are the ids of
its pre-tokens one after another. Texts of common characters are cut with the tokenizer's own pattern by
Python's ``re``; any other text (rare characters, strings of special tokens) is given to the library whole.
Which files can be read this way is checked on load, by the normalizer and pre-tokenizer they state.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

#: Characters on which ``re`` and the library agree about letters, digits, blanks and lower case.
_COMMON = "\\t\\n\\r\\x20-\\x7e¡§«°±¶·»¿À-ÖØ-öø-įı-ňŊ-ž–—‘-”…€"
_RARE = re.compile(f"[^{_COMMON}]")

# The pre-token patterns that the two tokenizer files state, in the notation of ``re``.
_BYTE_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the characters from 256 on for the other bytes in order."""
    other = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(next(other)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


class Pieces:
    """Cuts texts into pre-tokens and encodes distinct pre-tokens with the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        self.pattern = None
        if pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and norm is None:
            self.pattern, self.lower = _BYTE_PATTERN, False
        elif pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and norm and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            split = pre["pretokenizers"][0]
            if split["behavior"] == "Removed" and split["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                self.pattern, self.lower = _WORD_PATTERN, True

    #: Matches common letters, with or without a mark behind them: two pre-tokens or one, also behind a blank.
    marked = staticmethod(re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+)([.,;:!?]?)").fullmatch)

    @property
    def blank_first(self) -> bool:
        """Whether a single blank between other characters always begins a pre-token, and texts may be cut there."""
        return self.pattern is _BYTE_PATTERN and not any(" " in s or self.marked(s) for s in self.special)

    def cut(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if the library has to encode it whole."""
        if self.pattern is None or _RARE.search(text) or any(s in text for s in self.special):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def one(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        if self.pattern is _BYTE_PATTERN:  # in byte letters it is what the model itself reads
            return [t.id for t in self.model.tokenize((piece if piece.isascii() else piece.encode().decode("latin-1")).translate(_LETTERS))]
        (ids,) = self.encode((piece,))
        return ids

    def encode(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        if self.pattern is _BYTE_PATTERN:  # a pre-token in byte letters is what the model itself reads
            tokens = self.tokenizer.model.tokenize
            for piece in pieces:
                yield [t.id for t in tokens(piece.encode().decode("latin-1").translate(_LETTERS))]
            return
        for e in self.tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False):
            yield e.ids


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The tokenizer at a path, read once per Python worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
