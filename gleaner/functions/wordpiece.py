"""WordPiece ids from a tokenizer file, and ids by hash where there is none."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .vectors import code_points, without_marks

# Special tokens and the ids they have if the vocabulary doesn't name them; limits a file may leave out.
SPECIAL = {"[CLS]": 101, "[SEP]": 102, "[UNK]": 100, "[PAD]": 0}
MAX_WORD_BYTES, CONTINUED = 100, "##"
# Start and factor of the hash that stands in for a vocabulary, and the range of its ids.
HASH_START, HASH_TIMES, HASH_RANGE, HASH_FIRST = 2166136261, 16777619, 30000, 1000
_ASCII_MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Words whose ids a tokenizer remembers, and characters of the longest of them.
REMEMBERED, LONGEST = 100_000, 100


def is_punctuation(c: str) -> bool:
    return c in _ASCII_MARKS or unicodedata.category(c).startswith("P")


def plain(text: str) -> str:
    """Without accents, in lower case, white space as single blanks."""
    return " ".join(without_marks(text).lower().split())


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For every code point: 1 in words, 0 for white space, 2 for punctuation."""
    return np.fromiter((2 if is_punctuation(c) else 0 if c.isspace() else 1 for c in map(chr, range(sys.maxunicode + 1))), np.int8)


def pre_tokenize(text: str) -> list[str]:
    """Words between white space; each punctuation character is a word."""
    kind = np.concatenate([[0], _kinds()[code_points(text)], [0]])
    # a word goes on only from one character of words to another
    border = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] != 1))
    starts = kind[border + 1] > 0
    return [text[a:b] for a, b in zip(border[starts].tolist(), border[np.flatnonzero(starts) + 1].tolist())]


class _Ids(dict):
    """Ids of words that were asked for, up to a bound."""

    def __init__(self, pieces: Callable[[str], list[int]]):
        self.pieces = pieces

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.pieces(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class WordPiece:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._read(f.read())

    @classmethod
    def of(cls, text: str) -> WordPiece:
        """From what a tokenizer's file holds."""
        out = cls.__new__(cls)
        out._read(text)
        return out

    def _read(self, text: str) -> None:
        model = json.loads(text)["model"]
        if model.get("type") != "WordPiece":
            raise ValueError(f"a tokenizer of type {model.get('type')!r}; only WordPiece is read")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.continued = model.get("continuing_subword_prefix") or CONTINUED
        self.max_bytes = model.get("max_input_chars_per_word") or MAX_WORD_BYTES
        self.special = {k: self.vocabulary.get(k, i) for k, i in SPECIAL.items()}
        self.longest = max(map(len, self.vocabulary), default=0)
        self.longest_continued = max((len(w) - len(self.continued) for w in self.vocabulary if w.startswith(self.continued)), default=0)
        self._known = _Ids(self.pieces)

    def pieces(self, word: str) -> list[int]:
        """The longest pieces from the front on; one unknown id if that doesn't work out or the word is too long."""
        out, at, unknown = [], 0, [self.special["[UNK]"]]
        if len(word.encode()) > self.max_bytes:
            return unknown
        known = self.vocabulary.get
        while at < len(word):
            head, most = (self.continued, self.longest_continued) if at else ("", self.longest)
            for end in range(min(len(word), at + most), at, -1):
                piece = known(head + word[at:end])
                if piece is not None:
                    out.append(piece)
                    at = end
                    break
            else:
                return unknown
        return out

    def _inner(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self._known.__getitem__, pre_tokenize(plain(text))))

    def encode(self, text: str) -> list[int]:
        return [self.special["[CLS]"], *self._inner(text), self.special["[SEP]"]]

    def encode_array(self, text: str) -> np.ndarray:
        """``encode``, eight bytes an id."""
        inner = np.fromiter(self._inner(text), np.int64)
        return np.concatenate([[self.special["[CLS]"]], inner, [self.special["[SEP]"]]]).astype(np.int64, copy=False)


def hashed_id(word: str) -> int:
    h = HASH_START
    for c in word:
        h = ((h ^ ord(c)) * HASH_TIMES) & 0xFFFFFFFFFFFFFFFF
    return h % HASH_RANGE + HASH_FIRST


def hashed_ids(text: str) -> list[int]:
    """Ids of the lower-case words between white space."""
    return [hashed_id(w) for w in text.lower().split()]


@lru_cache(4)
def load(path: str) -> WordPiece:
    return WordPiece(path)
