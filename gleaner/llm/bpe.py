"""Byte-pair encoding and decoding with a distinct-word table.

Documents go through Spark in chunks.  A chunk's texts are split into words by the
tokenizer's own pattern; each chunk lists its distinct words, equal words of all chunks meet
in one bucket (by hash) and are encoded once there, and the ids are joined back to the chunk
and taken by position.  There are as many buckets as the input has partitions, so what a
bucket's task knows at once doesn't grow.  Decoding joins ids to pieces, a table as large as
the vocabulary whatever the input: the ids that a chunk has are joined once each, and a word's
bytes are glued from the pieces that the join has brought to its chunk.

Chunks are named by a hash of their contents, so a chunk computed again after a lost executor
meets the same words; were the input to change between the passes, the join would come up
short and the query would fail, not return wrong rows.

Defined results: a null text is an empty one (no tokens, the digest of nothing); repeated rows
and null ids keep their rows; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, staged
from .wordsplit import PATTERN, borders, distinct

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 24 << 20
#: Characters that the rank-based encoder takes at once.
STRETCH = 1 << 19


def byte_of_char() -> dict[str, int]:
    """Vocabulary files write a byte as the character of its number if that shows, else as the next one from 256 on."""
    shows = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shows)]
    return {chr(b): b for b in shows} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: pieces, special tokens, and encoders by word and by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        model = json.loads(open(path, encoding="utf-8").read())
        to_byte = byte_of_char()
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        raw = {k: bytes(to_byte[c] for c in k) for k in model["model"]["vocab"] if k not in self.special}
        self.pieces = {model["model"]["vocab"][k]: v for k, v in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        merged = [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        #: Whether ids rise with the merges, so that a rank-based encoder gives the same ids.
        self.ranked = all(a < b for a, b in zip(merged, merged[1:])) and all(len(self.pieces[i]) == 1 for i in self.pieces if i < 256)
        self._raw = raw
        self._vocab = model["model"]["vocab"]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, first and last places of their words, and the number of words of each; special tokens are words."""
        segments, whole, of = [], [], []
        for i, text in enumerate(texts):
            cut = self.cut is not None and any(s in text for s in self.special)
            for part in self.cut.split(text) if cut else [text]:
                segments.append(part.encode())
                whole.append(cut and part in self.special)
                of.append(i)
        data = np.frombuffer(b"".join(segments), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for x in segments], dtype=np.int64)])
        start = borders(data, at)
        owner = np.searchsorted(at, start, "right") - 1
        if any(whole):
            keep = ~(np.array(whole)[owner] & (start != at[owner]))
            start, owner = start[keep], owner[keep]
        return data, start, np.append(start[1:], len(data)), np.bincount(np.array(of, np.int64)[owner] if len(owner) else owner, minlength=len(texts))

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are words."""
        data, start, end, _ = self.spans([text])
        raw = data.tobytes()
        return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]

    @property
    @lru_cache(1)
    def fast(self):
        import tiktoken

        ranks = {v: self._vocab[k] for k, v in self._raw.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not self.ranked:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.concatenate([np.asarray(self.fast.encode(x, allowed_special="all"), "<u4") for x in self.stretches(text)])

    def stretches(self, text: str) -> list[str]:
        """A text cut between words, where the pattern splits each part as it splits the whole: behind something that isn't white space."""
        if len(text) <= STRETCH:
            return [text]
        out, held = [], []
        size = 0
        for word in self.split(text):
            held.append(word)
            size += len(word)
            if size >= STRETCH and not word[-1].isspace():
                out.append("".join(held))
                held, size = [], 0
        return [*out, "".join(held)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Codes(dict):
    """Words numbered as they first come up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _loosened(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _in_chunks(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[bytes, list, list[np.ndarray], list[int], _Codes]]:
    """Name, row keys, numbers of the words one after another, words of each row, and distinct words (bytes) of each chunk."""

    def started() -> tuple:
        return [], [], [], _Codes(), xxhash.xxh3_128()

    ids, codes, sizes, words, named = started()
    held = 0

    def take(texts: list[str]) -> None:
        data, start, end, n = v.spans(texts)
        which, first = distinct(data, start, end)
        raw = data.tobytes()
        own = np.fromiter((words[raw[a:b]] for a, b in zip(start[first].tolist(), end[first].tolist())), np.uint32, len(first))
        codes.append(own[which])
        sizes.extend(n.tolist())

    for b in batches:
        some: list[str] = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            some.append(text)
            ids.append(i)
            raw = text.encode()
            named.update(f"{i},{len(raw)};".encode())
            named.update(raw)
            held += len(raw)
            if held >= CHUNK_BYTES:
                take(some)
                yield named.digest(), ids, codes, sizes, words
                ids, codes, sizes, words, named = started()
                some, held = [], 0
        if some:
            take(some)
    if ids:
        yield named.digest(), ids, codes, sizes, words


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def coded_chunks(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """chunk, ids (the rows' keys), sizes (words of each row), codes (numbers of the words by falling frequency), rank (of each word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, codes, sizes, words in _in_chunks(batches, vocabulary(vocabulary_path)):
            flat = np.concatenate(codes)
            rank = np.empty(len(words), np.uint32)
            rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
            arrays = [pa.array([name], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_squeezed(rank[flat])], pa.binary()), pa.array([_squeezed(rank)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "sizes", "codes", "rank"])

    return _texts(docs, text, key).mapInArrow(run, "chunk binary, ids array<long>, sizes array<int>, codes binary, rank binary")


def chunk_words(docs: DataFrame, vocabulary_path: str, buckets: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """chunk, bucket, codes, sizes, words: each chunk's distinct words, dealt by hash into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, words in _in_chunks(batches, vocabulary(vocabulary_path)):
            raw = list(words)
            at = np.fromiter((crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(at, kind="stable")
            out: list[list] = [[], [], [], []]
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                listed = [raw[i] for i in own.tolist()]
                row = (int(at[own[0]]), _squeezed(np.diff(own, prepend=0)), _squeezed(np.array([len(w) for w in listed])), zstandard.compress(b"".join(listed), 3))
                for column, x in zip(out, row):
                    column.append(x)
            arrays = [pa.array([name] * len(out[0]), pa.binary()), pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "bucket", "codes", "sizes", "words"])

    return _texts(docs, text, key).mapInArrow(run, "chunk binary, bucket int, codes binary, sizes binary, words binary")


def word_table(listed: DataFrame, vocabulary_path: str) -> DataFrame:
    """chunk, codes, sizes, ids (packed), own (distinct ids): the ids of each chunk's words; a word is encoded once, where its bucket comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path).encode_words
        bucket, known = None, {}
        for b in batches:
            sizes, ids, each = [], [], []
            for at, n, words in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if at != bucket:
                    bucket, known = at, {}
                ends = np.cumsum(_loosened(n).astype(np.int64)).tolist()
                whole = zstandard.decompress(words)
                found = [whole[low:high] for low, high in zip([0, *ends], ends)]
                new = [w for w in found if w not in known]
                known |= {w: np.asarray(x, "<u4").tobytes() for w, x in zip(new, encode([w.decode() for w in new]))}
                own = [known[w] for w in found]
                sizes.append(_squeezed(np.array([len(x) // 4 for x in own])))
                flat = np.frombuffer(b"".join(own), "<u4")
                ids.append(_squeezed(flat))
                each.append(np.unique(flat).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary()), pa.array(each, pa.list_(pa.int32()))], ["chunk", "codes", "sizes", "ids", "own"])

    return listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk binary, codes binary, sizes binary, ids binary, own array<int>")


def piece_table(spark: SparkSession, vocabulary_path: str) -> DataFrame:
    """id, piece: as many rows as the vocabulary has, whatever the input."""
    return spark.createDataFrame(sorted(vocabulary(vocabulary_path).pieces.items()), "id int, piece binary")


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256; with_ids: also ids (array<int>) and decoded."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), docs.rdd.getNumPartitions())
    table = staged(word_table(chunk_words(docs, vocabulary_path, buckets, text, key), vocabulary_path), "bpe-words")
    # the ids of each chunk, no more than the vocabulary has, joined to their pieces
    listed = table.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    used = listed.select("chunk", F.explode("own").alias("id")).join(F.broadcast(piece_table(spark, vocabulary_path)), "id")
    right = table.drop("own").unionByName(used, allowMissingColumns=True)
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = right.filter(pc.is_valid(right["id"]))
        pieces = dict(zip(joined["id"].to_pylist(), joined["piece"].to_pylist()))
        number = {i: b"%d" % i for i in pieces}
        lists = right.filter(pc.is_valid(right["codes"]))
        lists = [tuple(_loosened(x) for x in row) for row in zip(*[lists[c].to_pylist() for c in ("codes", "sizes", "ids")])]
        out: list[list] = [[] for _ in names]
        for keys, sizes, codes, rank in zip(*[left[c].to_pylist() for c in ("ids", "sizes", "codes", "rank")]):
            rank, codes = _loosened(rank).astype(np.int64), _loosened(codes)
            said, glued = [b""] * len(rank), [b""] * len(rank)
            lengths = np.zeros(len(rank), np.int64)
            tokens: dict[int, list[int]] = {}
            for steps, n, ids in lists:
                at = rank[np.cumsum(steps.astype(np.int64))]
                n = n.astype(np.int64)
                lengths[at] = n
                flat = ids.tolist()
                spelt, cut = list(map(number.__getitem__, flat)), list(map(pieces.__getitem__, flat))
                low = 0
                for w, high in zip(at.tolist(), np.cumsum(n).tolist()):
                    if high - low == 1:
                        said[w], glued[w] = spelt[low], cut[low]
                    else:
                        said[w], glued[w] = b",".join(spelt[low:high]), b"".join(cut[low:high])
                    if with_ids:
                        tokens[w] = flat[low:high]
                    low = high
            if not lengths.all():
                raise RuntimeError("a chunk's words are missing: the input changed between two reads")
            upto = np.concatenate([[0], np.cumsum(lengths[codes])])
            at = 0
            for k, n in zip(keys, sizes):
                own = codes[at : at + n].tolist()
                decoded = b"".join(map(glued.__getitem__, own)).decode("utf-8", "replace")
                row = [k, int(upto[at + n] - upto[at]), hashlib.sha256(b",".join(map(said.__getitem__, own))).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                at += n
                for column, x in zip(out, row + ([[t for w in own for t in tokens[w]], decoded] if with_ids else [])):
                    column.append(x)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    done = coded_chunks(docs, vocabulary_path, text, key).groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)
    return done.withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded``: ids joined to pieces, whose number the vocabulary bounds."""
    spark = tokens.sparkSession
    pieces = piece_table(spark, vocabulary_path).toDF("_id", "_piece")
    rows = tokens.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.posexplode(F.col(f"`{ids}`")).alias("_at", "_id")).join(F.broadcast(pieces), "_id")
    glued = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.hex("_piece").alias("_piece")))).alias("_all"))
    text = F.decode(F.unhex(F.array_join(F.transform("_all", lambda x: x["_piece"]), "")), "utf-8")
    return rows.join(glued, "_row", "left").withColumn("decoded", F.coalesce(text, F.lit(""))).drop("_row", "_all")
