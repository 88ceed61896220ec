"""A byte-level tokenizer's words, by array operations on whole batches of texts.

The words are the matches of PATTERN: contractions, letters, numbers or other characters with
at most one blank before them, and white space.  Every rule of the pattern looks at classes of
neighbouring characters only, so borders follow from where classes change.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from .textnp import word_hashes

#: Fixed value: the pattern by which a byte-level tokenizer splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern sees it."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x01" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the places of their first bytes."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[place].astype(np.int32)
    if len(place) == len(data):
        return lead, place
    more = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(more == 0, lead, lead & (0x3F >> more))
    for k in (1, 2, 3):
        own = np.flatnonzero(more >= k)
        point[own] = (point[own] << 6) | (data[place[own] + k] & 0x3F)
    return point, place


def borders(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the first bytes of the words of texts laid end to end; ``at``: where texts begin, and the end."""
    point, place = code_points(data)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[point]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(place, at[at < len(data)])] = True
    first[n] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    solid = kind != SPACE
    blank = np.zeros(n, bool)  # a blank just before, in the same text
    blank[1:] = (point[:-1] == 32) & ~first[1:n]
    start = change[:n] & ~(solid & blank)
    # the last white space before something else stands apart from the white space before it
    before = np.zeros(n, bool)
    before[:-1] = solid[1:] & ~first[1:n]
    start |= ~solid & before
    # a contraction: an apostrophe that begins a word and is alone in its class, then certain letters
    quote = np.flatnonzero((point == 39) & start & ~blank)
    quote = quote[quote + 1 < n]
    quote = quote[change[quote + 1] & (kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one = point[quote + 1]
        ahead = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], point[ahead], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((quote[short], 2), (quote[long], 3)):
            start[which + 1] = False
            rest = which + size
            start[rest[rest < n]] = True
    return place[start]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte span the number of its content, by first appearance, and each content's first span.

    Spans are told apart by hashes, and every one is then compared with the first of its content.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, known_hashes = pd.factorize(word_hashes(data, start, end))
    first = np.empty(len(known_hashes), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    if not same_spans(data, start, end - start, start[first[which]], (end - start)[first[which]]):
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        first = np.unique(which, return_index=True)[1]
    return which, first


def same_spans(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether all pairs of spans have the same bytes."""
    if (a_size != b_size).any():
        return False
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    own, k = np.flatnonzero(a != b), 0
    while len(own):
        left = np.minimum(a_size[own] - k, 8).astype(np.uint64) * np.uint64(8)
        if ((eight[a[own] + k] ^ eight[b[own] + k]) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left))).any():
            return False
        k += 8
        own = own[a_size[own] > k]
    return True
