"""Posting lists of trigrams, and what a regular expression asks of them.

A posting is a trigram of a line, without regard to case, and some of the files that hold it; files are named by a hash of
source and path, so two of them may share a name and cost a look in vain.  Postings of one
partition are sorted by trigram and written without a shuffle; a search reads the pages that hold what it asks for.

An expression asks for all trigrams of the literals that every match must hold, or for those of one of its branches.  Where
nothing can be told (short literals, classes, syntax on which dialects differ), it asks for nothing, and every
file is searched.  Files found are searched as ever, so an index never changes a result.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small_batches

#: Trigrams of a literal that are looked up at most; fewer only let more files through.
ASKED = 8
#: Syntax that isn't read alike everywhere: quoting, properties, octal numbers, sets in sets, free spacing and switched flags.
_UNSURE = re.compile(r"\\[QEpPNxuc0hHRXGzZ]|\[[^\]]*(?:\[|&&)|\(\?[a-zA-Z]*[xd-][a-zA-Z-]*[:)]|\(\?[a-zA-Z]*U|\(\?P|\(\?\(|\(\?#")
#: ("all", trigrams) or ("any", conditions) or ("both", conditions); None if nothing can be told.
Condition = tuple[str, tuple] | None


@lru_cache(1)
def _folded() -> np.ndarray:
    """For every code point one that stands for it and all that match it regardless of case: the lower case of its upper case."""
    out = np.arange(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        upper = chr(c).upper()
        upper = upper if len(upper) == 1 else chr(c)
        lower = upper.lower()
        out[c] = ord(lower[0]) if len(lower) == 1 or upper == "\u0130" else ord(upper)
    return out


def grams_of(text: str) -> np.ndarray:
    """Different trigrams within the lines of a text, as numbers of 63 bits."""
    codes = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = (a != 10) & (b != 10) & (c != 10)
    return np.unique(((a << 42) | (b << 21) | c)[inside])


def file_name(source: str = "source_name", rel: str = "rel_path") -> Column:
    return F.xxhash64(source, rel)


def postings(docs: DataFrame) -> DataFrame:
    """gram, files: of documents (source_name, rel_path, content), sorted by gram within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [grams_of(t) for t in b.column(1).to_pylist()]
            grams = np.concatenate([*own, np.zeros(0, np.int64)])
            files = np.repeat(b.column(0).to_numpy(), [len(g) for g in own])
            order = np.argsort(grams, kind="stable")
            grams, files = grams[order], files[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)), pa.int32()), pa.array(files, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(grams[first], pa.int64()), lists], ["gram", "files"])

    small_batches(docs.sparkSession)
    texts = docs.filter("content IS NOT NULL").select(file_name().alias("file"), "content")
    return texts.mapInArrow(run, "gram long, files array<long>").sortWithinPartitions("gram")


def _of_literal(codes: list[int]) -> list[Condition]:
    found = grams_of("".join(map(chr, codes))).tolist()
    step = -(-len(found) // ASKED) if found else 1
    return [("all", tuple(found[::step]))] if found else []


def _of_items(items) -> list[Condition]:
    """Conditions that all hold for a match of a sequence."""
    out: list[Condition] = []
    literal: list[int] = []

    def ended() -> None:
        out.extend(_of_literal(literal))
        literal.clear()

    def each(items) -> None:
        for op, about in items:
            name = str(op)
            if name == "LITERAL" and about != 10:
                literal.append(about)
            elif name == "SUBPATTERN":
                each(about[-1])
            elif name == "ATOMIC_GROUP":
                each(about)
            else:
                ended()
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and about[0] >= 1:
                    out.extend(_of_items(about[2]))
                elif name == "BRANCH":
                    branches = [_of_items(x) for x in about[1]]
                    if all(branches):
                        out.append(("any", tuple(("both", tuple(x)) for x in branches)))

    each(items)
    ended()
    return out


def condition(pattern: str) -> Condition:
    """What a line must hold to match an expression, regardless of case; None: nothing can be told."""
    if _UNSURE.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    found = _of_items(parsed)
    return ("both", tuple(found)) if found else None


def holding(index: DataFrame, asked: Condition) -> DataFrame:
    """file: the names of the files that meet a condition, and maybe of others."""
    kind, parts = asked
    if kind == "all":
        each = index.filter(F.col("gram").isin(*parts)).select("gram", F.explode("files").alias("file"))
        return each.groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(parts)).select("file")
    found = [holding(index, x) for x in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more) if kind == "any" else out.join(more, "file", "left_semi")
    return out.distinct()


def worth_searching(rows: DataFrame, same: str, index: DataFrame, asked: Condition) -> DataFrame:
    """Rows (documents or files) that may match: those that the index knows (column ``same``) and finds, and all that it doesn't know."""
    found = holding(index, asked).select(F.col("file").alias("_file"), F.lit(True).alias("_found"))
    joined = rows.join(found, file_name() == F.col("_file"), "left")
    return joined.filter(~F.col(same) | F.col("_found")).drop("_file", "_found")
