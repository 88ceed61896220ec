"""Hash embeddings, accents and similarity as column expressions; an Arrow function for whole hash vectors."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Fixed values of the 64-bit FNV-1a hash.
BASIS, PRIME_LOW = 0xCBF29CE484222325, 435
_MASK = 0xFFFFFFFF
#: Characters whose words are hashed together, and hashes from which on those left are carried on one by one.
TOGETHER, FEW = 1 << 19, 8


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision over the shorter length; 0 for empty or zero vectors; as float."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.transform(F.slice(v, F.lit(1), n), lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = cut(a), cut(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norms > 0), dot(x, y) / norms).otherwise(F.lit(0.0)).cast("float")


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(1)
def _unmarked() -> np.ndarray:
    """For every code point whether it is no combining mark."""
    return np.fromiter((unicodedata.category(chr(c)) != "Mn" for c in range(sys.maxunicode + 1)), bool)


def without_marks(text: str) -> str:
    """Canonical decomposition without combining marks."""
    if text.isascii():
        return text
    codes = code_points(unicodedata.normalize("NFD", text))
    return codes[_unmarked()[codes]].tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(1)
def _accents() -> tuple[str, str, dict[str, str], str]:
    """From Unicode's canonical decompositions: characters that lose their marks and become one, those that they become; characters that become several; a class of marks."""
    single, several, marks = {}, {}, []
    for c in range(0x110000):
        if 0xAC00 <= c < 0xD7A4 or unicodedata.category(chr(c)) != "Mn" and unicodedata.decomposition(chr(c))[:1] in ("", "<"):  # Hangul syllables follow a rule of their own
            continue
        left = without_marks(chr(c))
        if not left:
            marks.append(c)
        elif left != chr(c):
            (single if len(left) == 1 else several)[chr(c)] = left
    known = set(marks)
    low = [c for c in marks if c - 1 not in known]
    high = [c for c in marks if c + 1 not in known]
    return "".join(single), "".join(single.values()), several, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(low, high)) + "]"


def _syllables(text: Column) -> Column:
    """Hangul syllables as their letters: 588 syllables begin alike, 28 have the first two letters in common."""
    leads, vowels, tails = ("".join(map(chr, range(low, low + n))) for low, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
    letter = lambda letters, n: F.substring(F.lit(letters), n.cast("int") + 1, F.lit(1))

    def split(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        tail = F.when(n % 28 > 0, letter(tails, n % 28 - 1)).otherwise("")
        return F.when((n >= 0) & (n < 11172), F.concat(letter(leads, F.floor(n / 588)), letter(vowels, F.floor(n % 588 / 28)), tail)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), split), "")


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without combining marks, by characters: each is translated, and what marks are left go.

    Texts of ASCII stay as they are.  Spacing marks keep their order.
    """
    before, after, several, marks = _accents()

    def replaced(t: Column) -> Column:
        out = t
        for c, left in several.items():
            out = F.replace(out, F.lit(c), F.lit(left))
        return F.when(t.rlike(f"[{''.join(several)}]"), out).otherwise(t)

    hangul = lambda t: F.when(t.rlike("[\uac00-\ud7a3]"), _syllables(t)).otherwise(t)
    # a class of hundreds of ranges is slow to ask; marks that the regular expressions' version of Unicode doesn't know are unassigned there
    unmarked = lambda t: F.when(t.rlike(r"[\p{Mn}\p{Cn}]"), F.regexp_replace(t, marks, "")).otherwise(t)
    rest = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(let(let(let(t, replaced), hangul), unmarked))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(let(F.translate(text, before, after), rest))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores, without accents."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"(?U)\s+", " "))


def fnv_halves(token: Column) -> Column:
    """64-bit FNV-1a as struct(hi, lo) of 32-bit halves, so that nothing overflows."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(token.cast("binary")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(BASIS >> 32).alias("hi"), F.lit(BASIS & _MASK).alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        low = h["lo"].bitwiseXOR(byte)
        up = h["hi"] * PRIME_LOW + low * 256 + F.shiftright(low * PRIME_LOW, 32)
        return F.struct(up.bitwiseAND(F.lit(_MASK)).alias("hi"), (low * PRIME_LOW).bitwiseAND(F.lit(_MASK)).alias("lo"))

    return F.aggregate(codes, start, step)


def token_slots(token: Column, dim: int) -> tuple[Column, Column, Column]:
    """First slot, its sign, and the second slot of a token in a vector of ``dim``."""
    h = fnv_halves(token)
    first = ((h["hi"] % dim) * (2**32 % dim) + h["lo"]) % dim
    sign = F.when(F.shiftright(h["lo"], 8).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    return first, sign, (h["hi"] * 65536 + F.shiftright(h["lo"], 16)) % dim


def _hash_on(h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a hashes, each carried on over ``size`` bytes of ``data`` from ``start`` on: all together byte position by byte position, the last few each alone."""
    order = np.argsort(-size, kind="stable")
    out, start, size = h[order], start[order], size[order]
    open_, k = np.searchsorted(-size, 0), 0
    while open_ > FEW:
        out[:open_] = (out[:open_] ^ data[start[:open_] + k]) * np.uint64((1 << 40) + PRIME_LOW)
        k += 1
        open_ = np.searchsorted(-size[:open_], -k)
    for i in range(open_):
        x = int(out[i])
        for byte in data[start[i] + k : start[i] + size[i]].tobytes():
            x = (x ^ byte) * ((1 << 40) + PRIME_LOW) & 0xFFFFFFFFFFFFFFFF
        out[i] = x
    back = np.empty_like(out)
    back[order] = out
    return back


def fnv1a(tokens: list[str]) -> np.ndarray:
    """64-bit FNV-1a of many tokens."""
    raw = [t.encode() for t in tokens]
    size = np.array([len(x) for x in raw], np.int64)
    return _hash_on(np.full(len(raw), BASIS, np.uint64), np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)


@lru_cache(1)
def _in_words() -> np.ndarray:
    """For every code point whether it belongs to words: what ``\\w`` matches."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[m.start() for m in re.finditer(r"\w", "".join(map(chr, range(sys.maxunicode + 1))))]] = True
    return out


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words and pairs of neighbours in texts: the text's place, the hash, the weight."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n\0\0\0".join([b"", *raw, b""]), "<u4")
    inside = _in_words()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[::2], edges[1::2]  # a break stands at both ends
    ends = np.cumsum([len(x) // 4 + 1 for x in raw])
    text = np.searchsorted(ends, first, "right")
    width = np.ones(len(codes), np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += codes >= least
    at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    data = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    start, size = at[first], at[last] - at[first]
    own = _hash_on(np.full(len(first), BASIS, np.uint64), data, start, size)
    # a pair's hash is its first word's, carried on
    pair = np.flatnonzero(text[1:] == text[:-1])
    joined = (own[pair] ^ np.uint64(ord("_"))) * np.uint64((1 << 40) + PRIME_LOW)
    joined = _hash_on(joined, data, start[pair + 1], size[pair + 1])
    return np.concatenate([text, text[pair]]), np.concatenate([own, joined]), np.repeat([1.0, 0.5], [len(own), len(joined)])


def slices(texts: list[str | None], most: int = TOGETHER) -> Iterator[list[str | None]]:
    """Texts in turn, of so many characters together at most, a longer one alone."""
    low = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > low and held + n > most:
            yield texts[low:i]
            low, held = i, 0
        held += n + 32  # that empty texts count, too
    if low < len(texts):
        yield texts[low:]


def embed_texts(texts: list[str | None], dim: int, normalize: bool = True) -> list[np.ndarray]:
    """Words count 1, pairs of neighbours a half; each adds its sign to one slot and a half of its weight to another."""
    out: list[np.ndarray] = []
    for some in slices(texts):
        place, h, weight = _word_hashes([without_marks(t or "").lower() for t in some])
        sign = np.where((h >> np.uint64(8)) & np.uint64(1), weight, -weight)
        slots = np.concatenate([h % np.uint64(dim), (h >> np.uint64(16)) % np.uint64(dim)]).astype(np.int64)
        v = np.bincount(slots + dim * np.tile(place, 2), np.concatenate([sign, 0.5 * weight]), dim * len(some)).reshape(-1, dim).astype(np.float32)  # multiples of a quarter: exact
        if normalize:
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
            v = v / np.where(norm > 0, norm, np.float32(1))[:, None]
        out += list(v)
    return out


def embed_text(text: str | None, dim: int, normalize: bool = True) -> np.ndarray:
    return embed_texts([text], dim, normalize)[0]


def hash_embedder(dim: int, normalize: bool = True):
    """Arrow function text -> array<float>; what a worker holds is bounded by a slice of a batch, whose vectors go on at once."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            for some in slices(s.tolist()):
                yield pd.Series(embed_texts(some, dim, normalize))

    return F.pandas_udf(embed, "array<float>")
