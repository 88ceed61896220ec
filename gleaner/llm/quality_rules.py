"""Quality rules by line-first cleaning.

Every line is judged by itself and by whether the text goes on in the next one: navigation, symbols, shouting,
boilerplate (phrases in English, French, German and Spanish that make up half of a line's words or more), and
closing punctuation, which a paragraph's last line needs if it is longer than a title.  A paragraph is a run of lines
with words, so a line that runs on into the next one needs no mark.  Lines that fail are removed,
and a document goes if more than MAX_LOST_PERCENT of its words stood in them, or if it fails the base
rules on words and repetition.  Symbols are counted, not judged, in whole documents, and
MIN_WORDS is asked of a document before cleaning.

What the rules ask of a line are sums over its words, so each different word is looked at once and
lines are summed by arrays.  All counts are exact: lines and words are compared as they are, not by hashes.

Defined results: a null or empty text has no words and is not kept; texts of any length are judged whole, a batch's
words as numbers of eight bytes; ties and repeated rows are judged alike and each keeps its row; an empty table gives an empty
result; columns of the input may have any names, they are carried only where asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import small_batches

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Per cent of a document's words that may stand in lines that fail.
MAX_LOST_PERCENT = 50
#: A symbol to this many words makes a line one of symbols.
MIN_WORDS_PER_SYMBOL = 4
#: A paragraph's last line of more words is no title and needs closing punctuation.
TITLE_WORDS = 12
#: Different words that a worker remembers.
REMEMBERED = 1 << 18

# Separators of navigation bars, symbols, marks that close nothing, categories of characters that close a sentence or a quotation.
SEPARATORS = "|>»·•"
SYMBOLS = "#*$%&|<>"
OPEN = "#*%&/\\@·•"
CLOSING = ("Po", "Pe", "Pf", "Pi")
SPACE = b" \t\n\r\x0b\x0c"
# Boilerplate in English, French, German and Spanish, in lower case.
BOILERPLATE = (
    "we use cookies", "this site uses cookies", "accept all cookies", "accept cookies", "cookie policy", "cookie settings", "enable javascript", "javascript is disabled", "all rights reserved", "terms of use", "terms of service", "terms and conditions",
    "privacy policy", "lorem ipsum", "sign in", "sign up", "log in", "log out", "share on", "click here", "read more", "subscribe to", "our newsletter", "skip to content", "back to top", "contact us", "about us",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "se connecter", "cliquez ici", "lire la suite", "partager sur",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "hier klicken", "weiterlesen", "jetzt anmelden", "teilen auf",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "iniciar sesión", "haga clic aquí", "leer más", "compartir en",
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "failed_words")
#: What a phrase is made of: letters, numbers, apostrophes.
_PIECE = re.compile(r"(?:[^\W_]|['’])+")
_PHRASES = [f" {'  '.join(_PIECE.findall(p))} " for p in BOILERPLATE]
_IN_PHRASES = {w for p in BOILERPLATE for w in _PIECE.findall(p)}


def boilerplate(line: str) -> bool:
    """Whether phrases make up half of a line's words or more."""
    pieces = _PIECE.findall(line.lower())
    left = f" {'  '.join(pieces)} "
    for phrase in _PHRASES:
        left = left.replace(phrase, " # ")
    covered = len(pieces) - sum(w != "#" for w in left.split())
    return covered > 0 and 2 * covered >= len(pieces)


class Words(dict):
    """Numbers of words (bytes), and of each what the rules ask: pieces, pieces that phrases have, separators, symbols, shouts, whether it closes a line."""

    def __init__(self):
        super().__init__()
        self.asked: list[tuple[int, int, int, int, int, int]] = []
        self.table = np.zeros((0, 6), np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        text = word.decode()
        if text.isalnum():
            self.asked.append((1, text.lower() in _IN_PHRASES, 0, 0, 0, 0))
        elif text[-1] in ".," and text[:-1].isalnum():
            self.asked.append((1, text[:-1].lower() in _IN_PHRASES, 0, 0, 0, 1))
        else:
            pieces = _PIECE.findall(text.lower())
            count = lambda marks: sum(text.count(c) for c in marks)
            closes = unicodedata.category(text[-1]) in CLOSING and text[-1] not in OPEN
            self.asked.append((len(pieces), sum(p in _IN_PHRASES for p in pieces), count(SEPARATORS), count(SYMBOLS), text.count("!!"), closes))
        return n

    def numbered(self) -> np.ndarray:
        """What is asked, by number."""
        if len(self.asked):
            self.table = np.concatenate([self.table, np.array(self.asked, np.int64)])
            self.asked.clear()
        return self.table

    def forget(self) -> None:
        self.__init__()
        self.clear()


def repeated_words(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Mask of the words in three-word windows that their text has twice or more, from words' numbers: compared as they are, not by hashes."""
    m = len(words) - 2
    if m < 1:
        return np.zeros(len(words), bool)
    inside = np.flatnonzero(owner[:m] == owner[2:])
    a, b, c = words[inside], words[inside + 1], words[inside + 2]
    wide, texts = int(words.max()) + 1, int(owner.max()) + 1
    if wide**3 * texts < 1 << 62:
        key = ((owner[inside] * wide + a) * wide + b) * wide + c
    else:  # pairs by numbers of their own, so that the product fits
        pair = np.unique(a * wide + b, return_inverse=True)[1]
        key = (owner[inside] * (int(pair.max(initial=0)) + 1) + pair) * wide + c
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(inside), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, inside[again], 1)
    np.add.at(cover, inside[again] + 3, -1)
    return np.cumsum(cover)[:-1] > 0


def failing(lines: list[bytes], n: np.ndarray, more: np.ndarray, words: np.ndarray, known: Words) -> np.ndarray:
    """Mask of the lines that fail; n: words of each, more: whether the next line of its text has any."""
    out = np.zeros(len(lines), bool)
    own = np.flatnonzero(n)
    if not len(own):
        return out
    asked, n, ends = known.numbered()[words], n[own], np.cumsum(n[own])
    pieces, phrased, bars, marks, shouts, _ = np.add.reduceat(asked, ends - n, axis=0).T
    fails = (bars >= 3) & (3 * bars >= n)
    fails |= (n >= 4) & ((MIN_WORDS_PER_SYMBOL * marks > n) | (2 * shouts > n))
    fails |= (n > TITLE_WORDS) & ~more[own] & (asked[ends - 1, 5] == 0)
    for i in np.flatnonzero(~fails & (phrased > 0) & (2 * phrased >= pieces)).tolist():
        fails[i] = boilerplate(lines[own[i]].decode())
    out[own] = fails
    return out


def judge(texts: pa.Array, known: Words) -> list[pa.Array]:
    """Columns of COUNTS, base_failed, kept and cleaned for a batch of texts."""
    if len(known) > REMEMBERED:
        known.forget()
    raw = [(t or "").encode() for t in texts.to_pylist()]
    by_text = [x.split(b"\n") for x in raw]
    size = np.array([len(lines) for lines in by_text], np.int64)
    counts, coded = [], [np.zeros(0, np.int64)]
    for lines in by_text:
        split = [x.split() for x in lines]
        counts += map(len, split)
        coded.append(np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64))
    n, words = np.array(counts, np.int64), np.concatenate(coded)
    owner_of_line = np.repeat(np.arange(len(raw)), size)
    more = np.zeros(len(n), bool)
    more[:-1] = (owner_of_line[1:] == owner_of_line[:-1]) & (n[1:] > 0)
    fails = failing([x for lines in by_text for x in lines], n, more, words, known)
    by_owner = lambda values: np.bincount(owner_of_line, values, len(raw)).astype(np.int64)  # noqa: E731  sums below 2 ** 53
    at = np.cumsum(size) - size
    worded = [[x for x, k in zip(lines, n[low : low + len(lines)].tolist()) if k] for lines, low in zip(by_text, at.tolist())]
    table = {
        "n_words": by_owner(n), "word_chars": np.array([len(t or "") - len(x) + len(x.translate(None, SPACE)) for t, x in zip(texts.to_pylist(), raw)], np.int64),
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS.encode())) for x in raw], np.int64), "n_dup_lines": np.array([len(x) - len(set(x)) for x in worded], np.int64),
        "n_lines": np.array([len(x) for x in worded], np.int64), "n_failed_lines": by_owner(fails), "failed_words": by_owner(n * fails),
    }
    owner = np.repeat(owner_of_line, n)
    table["n_repeat_words"] = np.bincount(owner[repeated_words(words, owner)], minlength=len(raw))
    failed = (table["n_words"] < MIN_WORDS) | (100 * table["n_repeat_words"] > MAX_REPEATED_PERCENT * table["n_words"])
    kept = ~failed & (100 * table["failed_words"] <= MAX_LOST_PERCENT * table["n_words"])
    cleaned = [None if t is None else b"\n".join(x for x, f in zip(lines, fails[low : low + len(lines)].tolist()) if not f).decode() for t, lines, low in zip(texts.to_pylist(), by_text, at.tolist())]
    return [*[pa.array(table[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(kept), pa.array(cleaned, pa.string())]


def _judged(docs: DataFrame, text: str, carry: list[str], cleaned: bool) -> tuple[DataFrame, list[str]]:
    """The carried columns under names of their own, then what ``judge`` finds; and those names."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col(f"`{text}`").cast("string").alias("text"))
    made = [*[StructField(c, LongType()) for c in COUNTS], StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), *([StructField("cleaned", StringType())] if cleaned else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *judge(b["text"], known)[: len(made)]], [*names, *[f.name for f in made]])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], *made])), names


def quality_rules(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), cleaned: bool = False) -> DataFrame:
    """Counts and verdict for each row: the carried columns, COUNTS, base_failed and kept (and the cleaned text if asked for)."""
    found, names = _judged(docs, text, list(carry), cleaned)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], *found.columns[len(names) :])


def keep_good(docs: DataFrame, text: str = "text", count: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` that pass, without the lines that fail (and the column ``count`` brought up to date)."""
    carry = [c for c in docs.columns if c != text]
    found, names = _judged(docs, text, carry, True)
    at = {c: F.col(n) for c, n in zip(carry, names)} | {text: F.col("cleaned").cast(docs.schema[text].dataType)}
    if count in docs.columns and count != text:
        at[count] = F.length("cleaned").cast(docs.schema[count].dataType)
    return found.filter("kept").select(*[at[c].alias(c) for c in docs.columns])
