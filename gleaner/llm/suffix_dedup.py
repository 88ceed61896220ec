"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that starts twice or more.

A string is looked for among those that select the same anchor.  The anchor of a string is
the least of its GRAM-byte runs (by hash, then by place), so equal strings have equal anchors
at equal offsets, and about one byte in eighty-five is an anchor.  Anchors that occur once are
dropped.  The strings of an anchor's occurrence make up its context, at most 2 * LENGTH bytes.

1. Equal contexts (counted before any shuffle of texts) have all their strings repeated.  One
   occurrence of each distinct context goes on where an anchor has several.
2. The strings of an anchor's distinct contexts are suffixes to sort: those of equal offset
   are merge-sorted, comparing by prefix polynomial hashes, where a binary search finds the
   common extension in log2(LENGTH) steps.  Order and equality of neighbours are verified byte
   by byte; a bucket that a collision has put out of order is sorted again by its bytes.
3. Anchors with more than LIMIT distinct contexts (a line of a third of all documents, say) are
   never gathered: their contexts are cut by offset into stretches, and dealt out anew by the
   bytes that all strings of a stretch share.  Equal stretches are counted like equal contexts,
   and one of each goes on; keys that still have more than LIMIT are cut in halves, and so on
   down to single strings, of which equal ones are the same stretch.

Contexts and stretches are equal if 128 bits of SHA-256 over their bytes are, so occurrences
needn't be brought together to be compared; polynomial hashes never decide what is removed.

Defined results: a null text is empty; texts of fewer than LENGTH bytes lose nothing unless
LENGTH is smaller; repeated rows and copies are texts of their own, so whole copies of LENGTH
bytes or more lose everything; matches never cross texts; null ids keep their rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_name, freed, small_batches, staged
from .textnp import mixed, prefix_hashes, run_hashes, span_hashes

LENGTH = 200
GRAM = 32
#: Distinct contexts of an anchor that one task may sort.
LIMIT = 2000
#: Bytes of a segment in which anchors are sought; places in it take the low 24 bits of a key.
SEGMENT = 1 << 20
#: Strings sorted at once.
BATCH_STRINGS = 1 << 18


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor's strings in texts laid end to end: text, place of the anchor and of the first string
    (in the text), number of strings, hash of the anchor, digest of the context."""
    found = []
    window = length - gram + 1
    whole = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))  # bytes from here to the text's end
    for low in range(0, max(1, len(data)), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        grams = mixed(run_hashes(part, gram))
        key = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        chosen = (sliding_least(key, window)[:n] & np.uint64(0xFFFFFF)).astype(np.int32)
        text, valid = whole[low : low + n], left[low : low + n] >= length
        change = np.ones(n, bool)
        change[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        first = np.flatnonzero(change & valid)
        if not len(first):
            continue
        breaks = np.flatnonzero(change | ~valid)
        after = np.searchsorted(breaks, first, "right")
        last = np.where(after < len(breaks), breaks[np.minimum(after, len(breaks) - 1)], n)
        place = chosen[first]
        owner, raw = text[first].astype(np.int64), part.tobytes()
        place = place.astype(np.int64)
        # the bytes of a context give the anchor's place in it
        context = [sha256(raw[x:y]).digest()[:16] for x, y in zip(first.tolist(), (last + length - 1).tolist())]
        found.append((owner, place + low - at[owner], first + low - at[owner], last - first, grams[place], np.frombuffer(b"".join(context), "V16")))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, "V16"))
    return tuple(np.concatenate(x) for x in zip(*found))


def digest(data: bytes, offset: int, key: int) -> bytes:
    """What names equal bytes at equal offsets from equal keys: 128 bits of SHA-256."""
    return sha256(b"%d,%d;%b" % (key, offset, data)).digest()[:16]


def sliding_least(key: np.ndarray, window: int) -> np.ndarray:
    """Least of each run of ``window`` keys, from running minima of blocks forwards and backwards."""
    n = len(key)
    padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, window)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - window + 1], forward[window - 1 : n])


class Suffixes:
    """Suffixes of one byte array, each with a number of bytes that count, compared by common extensions."""

    def __init__(self, data: np.ndarray):
        self.data, self.prefix = data, prefix_hashes(data)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to ``most``, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = span_hashes(self.prefix, a, a + middle) == span_hashes(self.prefix, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
        """Whether a sorts before b; one that ends inside another sorts before it."""
        most = np.minimum(a_size, b_size)
        n = self.common(a, b, most)
        last = len(self.data) - 1
        return np.where(n < most, self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)], a_size < b_size)

    def merge_sorted(self, place: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each bucket; ``bucket`` is ascending.

        Runs of 1, 2, 4, ... are merged in all buckets at once: a suffix's place in the merged
        run is its own plus the number of suffixes of the sibling run before it, by binary search.
        """
        order = np.arange(len(place))
        start = np.searchsorted(bucket, bucket, "left")
        many = np.searchsorted(bucket, bucket, "right") - start
        width = 1
        while True:
            active = np.flatnonzero(many > width)
            if not len(active):
                return order
            run = (active - start[active]) // width
            left = run % 2 == 0
            sibling = start[active] + np.where(left, run + 1, run - 1) * width
            end = start[active] + many[active]
            low, high = np.minimum(sibling, end), np.minimum(sibling + width, end)
            first = low.copy()
            own = order[active]
            while (left_open := np.flatnonzero(low < high)).size:
                middle = (low[left_open] + high[left_open]) // 2
                a, b = order[middle], own[left_open]
                # equal suffixes of the left run stand before those of the right
                swap = left[left_open]
                x, y = np.where(swap, a, b), np.where(swap, b, a)
                goes_before = self.less(place[x], size[x], place[y], size[y]) == swap
                low[left_open] = np.where(goes_before, middle + 1, low[left_open])
                high[left_open] = np.where(goes_before, high[left_open], middle)
            target = start[active] + (run - run % 2) * width + (active - start[active]) % width + (low - first)
            merged = order.copy()
            merged[target] = order[active]
            order = merged
            width *= 2

    def verified(self, order: np.ndarray, place: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """``order`` as it is if neighbours stand in order by their bytes; buckets where they don't are sorted by bytes."""
        beside = np.flatnonzero(bucket[1:] == bucket[:-1])
        wrong = []
        for k in range(0, len(beside), 4096):
            x, y = order[beside[k : k + 4096]], order[beside[k : k + 4096] + 1]
            most = np.minimum(size[x], size[y])
            reach = np.arange(most.max(initial=0))
            last = len(self.data) - 1
            a, b = (self.data[np.minimum(place[z][:, None] + reach, last)] for z in (x, y))
            differ = (a != b) & (reach < most[:, None])
            some = differ.any(axis=1)
            at = differ.argmax(axis=1) if len(reach) else np.zeros(len(x), np.int64)
            row = np.arange(len(x))
            right = np.where(some, a[row, at] < b[row, at], size[x] <= size[y]) if len(reach) else size[x] <= size[y]
            wrong.append(bucket[beside[k : k + 4096]][~right])
        for w in np.unique(np.concatenate(wrong)).tolist() if wrong else []:
            own = np.flatnonzero(bucket == w)
            order[own] = sorted(order[own].tolist(), key=lambda i: self.data[place[i] : place[i] + size[i]].tobytes())
        return order

    def longest(self, place: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Longest common extension of each suffix with another of its bucket: its neighbours', once sorted."""
        order = self.verified(self.merge_sorted(place, size, bucket), place, size, bucket)
        place, size = place[order], size[order]
        beside = np.where(bucket[1:] == bucket[:-1], self.common(place[:-1], place[1:], np.where(bucket[1:] == bucket[:-1], np.minimum(size[:-1], size[1:]), 0)), 0)
        out = np.zeros(len(place), np.int64)
        out[order[:-1]] = beside
        out[order[1:]] = np.maximum(out[order[1:]], beside)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether strings are equal: by extension, then verified byte by byte."""
        out = self.common(a, b, np.full(len(a), length)) == length
        reach = np.arange(length)
        for k in range(0, len(a), 4096):
            own = np.flatnonzero(out[k : k + 4096]) + k
            out[own] = (self.data[a[own, None] + reach] == self.data[b[own, None] + reach]).all(axis=1)
        return out


def repeated_strings(contexts: list[bytes], group: np.ndarray, align: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context a mask of its strings that occur in another context of its group at the same offset.

    Contexts of a group differ, and their rows stand together; ``align`` is the offset of a
    context's first string from its anchor.  All strings of a group hold the byte at the
    group's last offset.  Sorting the suffixes from there, forwards and backwards, gives how far
    any other context agrees with a context on either side, and so which strings may occur
    again.  Those are sorted themselves, except in groups of two, where the agreement is exact.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    counts = sizes - length + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    _, group, members = np.unique(group, return_inverse=True, return_counts=True)
    last = np.full(len(members), np.iinfo(np.int64).min)
    np.maximum.at(last, group, align + counts - 1)
    pivot = last[group] - align  # from a context's first byte
    by = np.argsort(group, kind="stable")
    forwards, backwards = Suffixes(data), Suffixes(data[::-1])
    right, left = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    right[by] = forwards.longest((begin + pivot)[by], (sizes - pivot)[by], group[by])
    left[by] = backwards.longest((len(data) - begin - pivot)[by], pivot[by], group[by])
    low, high = np.maximum(pivot - left, 0), np.minimum(pivot + right - length, counts - 1)
    out = [np.zeros(n, bool) for n in counts.tolist()]
    paired = (members[group] == 2) & (high >= low)
    for x, y in by[paired[by]].reshape(-1, 2).tolist() if paired.any() else []:
        a, b = contexts[x][low[x] : high[x] + length], contexts[y][low[y] : high[y] + length]
        if a == b:
            out[x][low[x] : high[x] + 1] = out[y][low[y] : high[y] + 1] = True
        else:  # a collision of hashes
            paired[x] = paired[y] = False
    rest = np.flatnonzero(~paired & (high >= low))
    n = (high - low + 1)[rest]
    which = np.repeat(rest, n)
    index = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    offset = align[which] + index
    order = np.lexsort((offset, group[which]))
    which, index, offset = which[order], index[order], offset[order]
    change = np.ones(len(which), bool)
    change[1:] = (group[which][1:] != group[which][:-1]) | (offset[1:] != offset[:-1])
    bucket = np.cumsum(change)
    shared = np.bincount(bucket)[bucket] > 1
    which, index, bucket = which[shared], index[shared], bucket[shared]
    if len(which):
        place = begin[which] + index
        size = np.full(len(place), length)
        order = forwards.verified(forwards.merge_sorted(place, size, bucket), place, size, bucket)
        together = np.flatnonzero(bucket[1:] == bucket[:-1])
        same = together[forwards.equal(place[order[together]], place[order[together + 1]], length)]
        for k in np.unique(np.concatenate([order[same], order[same + 1]])).tolist():
            out[which[k]][index[k]] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _loosened(packed: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in packed.to_pylist()]


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """row, anchor, context, place (of the first string), off (the anchor's from it), n (strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _loosened(b["packed"])
            at = np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64)])
            text, place, first, n, anchor, context = anchors(np.frombuffer(b"".join(whole), np.uint8), at, length, gram)
            names = pa.Array.from_buffers(pa.binary(16), len(context), [None, pa.py_buffer(context.tobytes())]).cast(pa.binary())
            columns = [b["row"].take(pa.array(text)), pa.array(anchor.view(np.int64)), names, pa.array(first), pa.array((place - first).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "anchor", "context", "place", "off", "n"])

    return texts.select("row", "packed").mapInArrow(run, "row long, anchor long, context binary, place long, off int, n int")


_PART = "key long, row long, place long, align int, whole boolean, bytes binary"
_PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _batch(schema: str, types: list[pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], [x.split()[0] for x in schema.split(", ")])


def _cut(wanted: DataFrame, length: int) -> DataFrame:
    """Contexts as parts (anchor's key, place of the first string and its offset from the anchor), from a packed text and the list of its wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, text, listed in zip(b["row"].to_pylist(), _loosened(b["packed"]), b["wanted"].to_pylist()):
                for x in listed:
                    values = (x["anchor"], row, x["place"], -x["off"], x["copies"] > 1, text[x["place"] : x["place"] + x["n"] + length - 1])
                    for column, v in zip(out, values):
                        column.append(v)
            yield _batch(_PART, _PART_TYPES, out)

    return wanted.mapInArrow(run, _PART)


def _split(parts: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Parts cut at offsets from the anchor, every ``width``, so that equal strings land in equal stretches; ``check`` names equal ones.

    The key is a hash of the bytes that all strings of a stretch share, the last start to the first end.
    """
    origin = gram - length
    schema = f"{_PART}, check binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, row, place, align, whole, data in zip(*[c.to_pylist() for c in b.columns]):
                n = len(data) - length + 1
                for border in range(align - (align - origin) % width, align + n, width):
                    low, high = max(border - align, 0), min(border + width - align, n)
                    shared = digest(data[border + width - 1 - align : border + length - align], border, key)
                    stretch = data[low : high + length - 1]
                    values = (int.from_bytes(shared[:8], "little", signed=True), row, place + low, align + low, whole, stretch, digest(stretch, align + low, key))
                    for column, v in zip(out, values):
                        column.append(v)
            yield _batch(schema, [*_PART_TYPES, pa.binary()], out)

    return parts.select(*[x.split()[0] for x in _PART.split(", ")]).mapInArrow(run, schema)


def _sorted_parts(parts: DataFrame, length: int) -> DataFrame:
    """row, start, end: what the strings found repeated among the parts of each key cover; whole parts are known already."""

    def handle(rows: list[tuple]) -> pa.RecordBatch:
        found: tuple[list, list, list] = ([], [], [])
        number = {k: i for i, k in enumerate(dict.fromkeys(x[0] for x in rows))}
        masks = repeated_strings([x[5] for x in rows], np.array([number[x[0]] for x in rows]), np.array([x[3] for x in rows]), length)
        for (_, row, place, _, whole, _), mask in zip(rows, masks):
            if not whole:
                for low, high in zip(*runs(mask)):
                    for column, v in zip(found, (row, place + int(low), place + int(high) + length)):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, strings = [], 0
        for b in batches:
            for x in zip(*[c.to_pylist() for c in b.columns]):
                if strings >= BATCH_STRINGS and x[0] != rows[-1][0]:
                    yield handle(rows)
                    rows, strings = [], 0
                rows.append(x)
                strings += len(x[5]) - length + 1
        if rows:
            yield handle(rows)

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, start long, end long")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, spans (array of start, end): bytes to remove.  texts: row (a number of its own), packed."""
    every = staged(_anchor_rows(texts, length, gram), "suffix-every")
    # tables joined to skewed ones are written first, so that both sides are plain exchanges and hot partitions can be split
    several = staged(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).filter("all > 1").select("anchor"), "suffix-several")
    found = staged(every.join(several, "anchor"), "suffix-anchors")
    freed(every, several)
    contexts = found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "place", "off", "n")).alias("one"))
    contexts = staged(contexts.select("anchor", "context", "copies", "one.*"), "suffix-contexts")
    number = staged(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "suffix-numbers")
    listed = contexts.join(number.select("anchor"), "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "place", "off", "n", "copies")).alias("wanted"))
    part = _cut(texts.select("row", "packed").join(listed, "row").select("row", "packed", "wanted"), length)
    columns = part.columns
    copied = found.join(contexts.filter("copies > 1").select("anchor", "context"), ["anchor", "context"])
    spans = [copied.select("row", F.col("place").alias("start"), (F.col("place") + F.col("n") + (length - 1)).alias("end"))]

    made: list[DataFrame] = []
    common = number.filter(F.col("contexts") > LIMIT).select(F.col("anchor").alias("key"))
    if common.isEmpty():
        few = part
    else:
        part = staged(part, "suffix-parts")
        made.append(part)
        few = part.join(common, "key", "left_anti").select(*columns)
        width = 1 << (max(1, (length - gram + 1) // 5).bit_length() - 1)
        while True:
            stretch = staged(_split(part.join(common, "key", "left_semi"), width, length, gram), "suffix-stretches")
            same = stretch.groupBy("key", "check").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "place", "align", "whole", "bytes")).alias("one"))
            same = staged(same.select("key", "check", "copies", "one.*"), "suffix-same")
            again = stretch.filter("not whole").join(same.filter("copies > 1").select("key", "check"), ["key", "check"])
            spans.append(again.select("row", F.col("place").alias("start"), (F.col("place") + F.octet_length("bytes")).alias("end")))
            part = same.withColumn("whole", F.col("whole") | (F.col("copies") > 1)).select(*columns)
            sizes = part.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            few = few.unionByName(part.join(sizes.filter((F.col("size") > 1) & (F.col("size") <= LIMIT)).select("key"), "key").select(*columns))
            common = staged(sizes.filter(F.col("size") > LIMIT).select("key"), "suffix-common")
            made += [stretch, same, common]
            if width == 1 or common.isEmpty():  # the strings of a key of single ones are equal
                break
            width //= 2
    spans.append(_sorted_parts(few.select(*columns), length))
    all_spans = spans[0]
    for more in spans[1:]:
        all_spans = all_spans.unionByName(more)
    out = staged(all_spans.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "suffix-spans")
    freed(found, contexts, number, *made)
    return out


def numbered(docs: DataFrame, text: str, carry: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """row (a number of its own for each row), packed (the text's bytes, compressed) and the carried columns under the names returned.

    Written, so that numbers stay.
    """
    names = [f"c{i}" for i in range(len(carry))]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), body.alias("packed"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([pack(x) for x in b["packed"].to_pylist()], pa.binary()), *b.columns[2:]], ["row", "packed", *names])

    return staged(rows.mapInArrow(squeeze, rows.schema), "suffix-texts"), names


def _removed(docs: DataFrame, text: str, carry: tuple[str, ...], with_text: bool, length: int, gram: int, left: list[DataFrame] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """What ``remove_repeats`` returns, with the carried columns under names of their own: those, and the names made."""
    small_batches(docs.sparkSession)
    texts, names = numbered(docs, text, carry)
    made = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField(n, StringType()) for n in ("kept_sha256", "kept")[: 1 + with_text]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in made]
            for data, listed in zip(_loosened(b["packed"]), b["spans"].to_pylist()):
                pieces, at = [], 0
                removed: list[list[int]] = []
                for x in sorted(listed or [], key=lambda x: x["start"]):
                    if removed and x["start"] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], x["end"])
                    else:
                        removed.append([x["start"], x["end"]])
                for low, high in removed:
                    pieces.append(data[at:low])
                    at = high
                pieces.append(data[at:])
                rest = b"".join(pieces)
                for column, v in zip(out, (len(data), len(data) - len(rest), len(removed), sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))):
                    column.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], *[pa.array(x, t) for x, t in zip(out, types)]], [*names, *[f.name for f in made]])

    spans = repeated_spans(texts, length, gram)
    if left is not None:
        left += [texts, spans]
    ready = texts.join(spans, "row", "left").select("packed", "spans", *names)
    return ready.mapInArrow(run, StructType([*[texts.schema[n] for n in names], *made])), names, [f.name for f in made]


def remove_repeats(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_text: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The carried columns, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept (the text that stays, of whole characters)."""
    done, names, made = _removed(docs, text, carry, with_text, length, gram)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], *made)


def without_repeats(docs: DataFrame, text: str = "text", count: str | None = "n_chars", left: list[DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts (and the column ``count`` brought up to date).

    A character of which only some bytes stay goes too; null texts stay null.  ``left`` gets the written tables that the
    result reads, to be freed once it is written.
    """
    missing = free_name(docs, "missing")
    carry = [*[c for c in docs.columns if c != text], missing]
    done, names, _ = _removed(docs.withColumn(missing, F.col(f"`{text}`").isNull()), text, tuple(carry), True, LENGTH, GRAM, left)
    at = {c: F.col(n) for c, n in zip(carry, names)}
    at[text] = F.when(at[missing], F.lit(None).cast("string")).otherwise(F.col("kept"))
    if count in docs.columns and count != text:
        at[count] = F.length(at[text]).cast(docs.schema[count].dataType)
    return done.select(*[at[c].alias(c) for c in docs.columns])
