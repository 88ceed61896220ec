"""WARC archives with a two-level capture index.

Writing: equal payloads of at least SHARED bytes are stored once; the other captures become
revisit records.  Each task writes an archive of its own, a gzip member a record, below the
shared folder; a name holds the task's attempt, and only archives that the committed record
list names are read, so a task that runs twice does no harm.

Index: captures are ordered by reversed-host key (range partitions, sorted), written as
compressed blocks of BLOCK lines into one file a partition, and a sparse directory keeps
each block's first key and byte range.  Lookup finds a key's partition by bisecting the
partitions' first keys (as many as partitions), its block by bisecting that partition's
directory, reads that byte range, bisects the block's lines, and reads the record's range.
Nothing scans an archive.

Files are read and written by pyarrow's file systems, from the URI of the shared folder.

Defined results: a null html is an empty payload; a null url has the empty key; page_id
takes part in the key, so equal urls are told apart; rows of equal page_id and payload are
alike, and of those with the largest page_id of a payload each is a response; a null page_id
is smaller than any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, partitions, small_batches, staged

SHARED = 1000
#: Captures in a block of the index, and about so many in a part of it.
BLOCK, PART = 512, 1 << 17
#: Bytes of an archive that one task reads, while that makes no more than MOST_READS tasks.
STRETCH, MOST_READS = 4 << 20, 20_000
#: Fixed values of the format.
VERSION, PROFILE, DATE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def surt(url: Column) -> Column:
    """Reversed-host key: https://a.b.org:80/x?y becomes org,b,a:80)/x?y; empty without a host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^:/?#]*://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#:]*(.*)$", 1)
    return F.when(rest == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.regexp_replace(tail, r"^(:\d+)?", "$1)")))


def capture_key(url: Column, page_id: Column, digest: Column) -> Column:
    """Sort key of a capture: its url's key, its number and its digest, so that only equal rows have equal keys."""
    return F.concat(surt(url), F.lit(" "), F.coalesce(F.lpad(F.hex(page_id), 16, "0"), F.lit("-")), F.lit(" "), digest)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response, or a revisit, which has no block but states the payload's length and digest."""
    name = lambda i: f"<urn:page:{'-' if i is None else i}>"
    revisit = refers_to is not None
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    body = b"" if revisit else HTTP.format(len(payload)).encode() + payload
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; checks the block's length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it states")
    return headers, rest[:n]


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; key (of the capture), file, offset, length for each record."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), F.sha1(body).alias("digest"), body.alias("payload"))
    large = rows.filter(F.octet_length("payload") >= SHARED).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(large.select("digest", "first"), "warc-shared")
    refers = F.when((F.octet_length("payload") >= SHARED) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    decided = rows.join(shared, "digest", "left").select("id", "url", "digest", "payload", refers.alias("refers_to"), capture_key(F.col("url"), F.col("id"), F.col("digest")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store, place = opened(path)
        out, at = None, 0
        for b in batches:
            keys, offsets, lengths = [], [], []
            for i, u, digest, payload, first, k in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place, compression=None)
                member = gzip.compress(record(i, u, payload, digest, first), 4, mtime=0)
                out.write(member)
                keys.append(k)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([path] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return staged(decided.mapInArrow(run, "key string, file string, offset long, length long"), "warc-records")


def write_index(records: DataFrame, folder: str) -> DataFrame:
    """Write the index's blocks; the directory: part, first (key), file, offset, length of each block."""
    parts = max(partitions(records.sparkSession), -(-records.count() // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.cdx.gz"
        store, place = opened(path)
        out, at, lines, rows = None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
            block = zlib.compress("\n".join("\t".join([_line_safe(k), f, str(o), str(n)]) for k, f, o, n in lines).encode(), 6)
            out.write(block)
            rows.append((task.partitionId(), lines[0][0], path, at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for x in zip(*[c.to_pylist() for c in b.columns]):
                lines.append(x)
                if len(lines) >= BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["part", "first", "file", "offset", "length"])

    ordered = records.select("key", "file", "offset", "length").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return staged(ordered.mapInArrow(run, "part int, first string, file string, offset long, length long"), "warc-directory")


def _line_safe(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A")


def look_up(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """key, file, offset, length of each wanted capture (column key) that the index holds."""
    # first keys of the index's partitions, as many as there are partitions
    borders = sorted((_order(r["first"]), r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("first")).collect())
    firsts, parts = [b[0] for b in borders], [b[1] for b in borders]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(firsts, _order(k)) - 1 for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parts[i] if i >= 0 else None for i in at], pa.int32())], ["key", "part"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = sorted(zip(*[right[c].to_pylist() for c in ("first", "file", "offset", "length")]), key=lambda x: _order(x[0]))
        starts = [_order(x[0]) for x in blocks]
        out: list[list] = [[], [], [], []]
        held, lines, keys, source, source_path = -1, [], [], None, None
        for k in sorted(left["key"].to_pylist(), key=_order):
            at = bisect_right(starts, _order(k)) - 1
            if at < 0:
                continue
            if at != held:
                _, path, offset, length = blocks[at]
                if path != source_path:
                    store, place = opened(path)
                    source, source_path = store.open_input_file(place), path
                lines = [x.split("\t") for x in zlib.decompress(source.read_at(length, offset)).decode().split("\n")]
                keys, held = [_order(x[0].replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")) for x in lines], at
            # repeated rows have equal keys, in one block or running over its end; each wanted key takes the last
            found = bisect_right(keys, _order(k)) - 1
            if found >= 0 and keys[found] == _order(k):
                for column, x in zip(out, (k, lines[found][1], int(lines[found][2]), int(lines[found][3]))):
                    column.append(x)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    asked = wanted.select("key").mapInArrow(routed, "key string, part int").filter("part is not null")
    return asked.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(search, "key string, file string, offset long, length long")


def _order(key: str) -> bytes:
    """Spark orders strings by their UTF-8 bytes."""
    return key.encode()


def read_records(found: DataFrame, size: int, with_payload: bool = False) -> DataFrame:
    """Of ``size`` bytes of records: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for a revisit) by range reads."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x == "<urn:page:->" else int(x[len("<urn:page:") : -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, source_path = None, None
        for b in batches:
            out: list[list] = [[] for _ in names]
            for path, offset, length in zip(*[b[c].to_pylist() for c in ("file", "offset", "length")]):
                if path != source_path:
                    store, place = opened(path)
                    source, source_path = store.open_input_file(place), path
                headers, body = parsed(gzip.decompress(source.read_at(length, offset)))
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit:
                    body = body.partition(b"\r\n\r\n")[2]
                    if hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError("a payload doesn't have the digest that its record states")
                size = int(headers["X-Payload-Length"]) if revisit else len(body)
                row = (number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, "revisit" if revisit else "response", number(headers["WARC-Refers-To"]) if revisit else None, None if revisit else body)
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # stretches of an archive are dealt out, by a number of tasks that the bytes to read give
    each = max(STRETCH, size // MOST_READS)
    dealt = found.repartition(max(1, -(-size // each)), "file", F.floor(F.col("offset") / each))
    return dealt.sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, fields)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Write all pages, index them, look every one of them up and read its record back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    records = write_archives(pages, f"{folder}/archives", key, url, html)
    directory = write_index(records, f"{folder}/index")
    digest = F.sha1(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary"))
    wanted = pages.select(capture_key(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.col(f"`{key}`").cast("long"), digest).alias("key"))
    size = records.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read_records(look_up(wanted, directory), size, with_payload)
