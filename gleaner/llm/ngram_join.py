"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of hashed runs of five words (64 bits each, mixed at every step).
Documents whose sets have one SHA-256 name (128 bits) are one node, so copies never meet each other.  A node has HASHES MinHash values; nodes that agree on all
values of one of BANDS bands are candidates.  At a similarity of 0.8 a pair misses every band
with a probability of 5e-8.  Pairs are compared value by value, in steps of STEP: with m of n
values equal the posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1),
and a pair is dropped as soon as its probability of reaching the threshold falls below
TOLERANCE.  The rest is verified exactly on the sets.

Pairs are never rows.  A bucket of candidates, and later a cluster of survivors, is cut by
hash into blocks; each pair of blocks is a tile, handled in one task, and a tile only emits
what is linear in its nodes: a spanning forest, and numbers of links.  So the clusters that
surviving candidates connect come first (connected components by rounds of joins), then all
pairs of a cluster are verified tile by tile, which counts every node's links exactly, and
the verified links' components are the classes.

Defined results: words are runs of characters other than 0x20 and 0x09 to 0x0D, as they
stand; a document of one to four words has one shingle, all its words; null, empty or blank
texts have none, no links, and are a class each; texts of any length count with all their shingles, a set of eight bytes a
shingle being held for one text at a time and compared in stretches; repeated rows are documents of their own
(and linked, if they have words); class_id is the class's smallest id (null if it has none);
an empty table gives an empty result; columns of any other name are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, numbered, small_batches, staged
from .textnp import flat, mixed, runs_hash, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Most nodes in a block of a bucket of candidates, and of a cluster to verify.
CANDIDATE_BLOCK, VERIFY_BLOCK = 2048, 1024
#: Fewer nodes than fill a block are still dealt over so many, if each gets SMALL_BLOCK or more.
BLOCKS, SMALL_BLOCK = 4, 64
#: Rows (two numbers each) that are broadcast to fetch their texts; more are joined by a shuffle.
MOST_ROWS = 500_000
#: Links that a task of a round of components writes.
LINKS = 100_000
#: Pairs in a tile beyond which matrix products intersect its sets, and shingles in a product.
MANY_PAIRS, STRETCH = 200, 8192


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = flat(texts)
    start, end, owner = words(data, at)
    values = word_hashes(data, start, end)
    shingles, first = runs_hash(values, owner, n)
    owners = owner[first]
    counts = np.bincount(owner, minlength=len(at) - 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    edges = np.searchsorted(owners, np.arange(len(at)))
    out = []
    for i in range(len(at) - 1):
        if 0 < counts[i] < n:
            out.append(runs_hash(values[bounds[i] : bounds[i + 1]], np.zeros(counts[i], np.int64), int(counts[i]))[0])
        else:
            out.append(np.unique(shingles[edges[i] : edges[i + 1]]))
    return out


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:HASHES] | np.uint64(1)).astype(np.uint32) | np.uint32(1), seed[HASHES:].astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of a set: minima under multiply-and-xor permutations of 32 bits."""
    times, plus = _permutations()
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        x = (low[k : k + 512, None] ^ plus) * times
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values: the fewest that must be equal for the posterior of reaching the threshold to stay at the tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signature rows that pass every step; same: each unordered pair once."""
    i, j = np.triu_indices(len(left), 1) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    matches = np.zeros(len(i), np.int32)
    for n, least in least_matches().items():
        for low in range(0, len(i), 1 << 16):
            cut = slice(low, low + (1 << 16))
            matches[cut] += (left[i[cut], n - STEP : n] == right[j[cut], n - STEP : n]).sum(axis=1)
        passed = matches >= least
        i, j, matches = i[passed], j[passed], matches[passed]
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links enough to connect what the pairs (i, j) of n nodes connect."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def tiles(rows: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """``rows`` once for each tile of their group, with ``tile`` (a number for the group and two blocks) and
    ``side`` (0 or 1, or 2 where both blocks are the row's own).  Column n: the rows of each row's group."""
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.lit(BLOCKS), F.ceil(F.col("n") / min(SMALL_BLOCK, block)))).cast("int")
    rows = rows.withColumns({"_own": F.pmod(F.xxhash64(node, F.lit(block)), blocks).cast("int"), "_blocks": blocks})
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return rows.withColumns({"tile": F.xxhash64(group, low, high), "side": side.cast("int")}).drop("n", "_own", "_other", "_blocks")


def in_tiles(rows: DataFrame, schema: str, handle: Callable[[pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """Each tile's rows together, many tiles to a task, one at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            tile = b["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            if held and held[-1]["tile"][0].as_py() != tile[0]:
                yield from filter(None, [handle(pa.Table.from_batches(held))])
                held = []
            for low, high in zip(cuts, cuts[1:]):
                if low:
                    yield from filter(None, [handle(pa.Table.from_batches(held))])
                    held = []
                held.append(b.slice(low, high - low))
        if held:
            yield from filter(None, [handle(pa.Table.from_batches(held))])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def _rows(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    side = t["side"].to_numpy()
    if len(side) and side[0] == 2:
        return t, t, True
    return t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)), False


def _linked(t: pa.Table) -> pa.RecordBatch | None:
    """Spanning forest of a tile's surviving candidates."""
    left, right, same = _sides(t)
    if not left.num_rows or not right.num_rows:
        return None
    i, j = survivors(_rows(left["light"], np.uint8), _rows(right["light"], np.uint8), same)
    a, b = left["node"].to_numpy(), right["node"].to_numpy()
    pairs = forest(i, j if same else j + len(a), len(a) + (0 if same else len(b)))
    names = a if same else np.concatenate([a, b])
    return pa.RecordBatch.from_arrays([pa.array(names[[p[k] for p in pairs]].astype(np.int64)) for k in (0, 1)], ["a", "b"]) if pairs else None


def _verified(t: pa.Table) -> pa.RecordBatch | None:
    """For each node of a tile with links: their number, counting copies, and the forest's links."""
    left, right, same = _sides(t)
    if not left.num_rows or not right.num_rows:
        return None
    i, j = survivors(_rows(left["light"], np.uint8), _rows(right["light"], np.uint8), same)
    a, b = ([np.frombuffer(x, np.uint64) for x in side["shingles"].to_pylist()] for side in (left, right))
    if len(i) > MANY_PAIRS:
        common = _intersections(a, b)[i, j]
    else:
        common = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    ok = common >= THRESHOLD * (sizes[0][i] + sizes[1][j] - common) - 1e-9
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    a, b = left["node"].to_numpy(), right["node"].to_numpy()
    names = a if same else np.concatenate([a, b])
    copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()]) if not same else left["copies"].to_numpy()
    j = j if same else j + len(a)
    links = np.zeros(len(names), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    own = np.flatnonzero(links)
    pairs = forest(i, j, len(names))
    columns = [np.concatenate([names[own], names[[p[0] for p in pairs]]]), np.concatenate([names[own], names[[p[1] for p in pairs]]]), np.concatenate([links[own], np.zeros(len(pairs), np.int64)])]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "links"])


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices over stretches of the shingles both have."""
    known = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(known), STRETCH):
        part = known[low : low + STRETCH]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(m, sets):
                row[np.searchsorted(part, s[np.isin(s, part, assume_unique=True)])] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root (its component's smallest node) for every node of the links (a, b).

    Rounds of joins until nothing changes: each node points at the smallest node it knows of,
    links move to where their ends point (large star), then pointers are shortened (small star).
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    n = edges.count()
    before = None

    def kept(df: DataFrame) -> DataFrame:
        """Written by as many tasks as so few rows need; rows of a round are as many as links at most."""
        return staged(df.coalesce(n // LINKS + 1), name)

    while True:
        old = edges
        # large star: every neighbour above the centre goes to the centre's smallest
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that a hot centre's links can be split in the join
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every neighbour below the centre, and the centre, goes to the smallest
        large = kept(large.filter("a <> b").distinct())
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = kept(small.filter("a <> b").distinct())
        freed(old, least, large, low)
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def signatures(texts: DataFrame) -> DataFrame:
    """id, row, name (128 bits of the set; null without words), signature (16 bits a value) and light (8 bits a value)."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, signature, light = [], [], []
            for s in shingle_sets(b.column(2)):
                named.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
                values = minhash(s)
                signature.append(values.astype("<u2").tobytes())
                light.append(values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.binary()), pa.array(signature, pa.binary()), pa.array(light, pa.binary())], ["id", "row", "name", "signature", "light"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, row long, name binary, signature binary, light binary")


def _sets(texts: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and the shingles of ``text``."""
    fields = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column(len(carry)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], [*carry, "shingles"])

    return texts.select(*carry, "text").mapInArrow(run, f"{fields}, shingles binary")


def classes(docs: DataFrame, row: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, row, name (null without words), root, class_id, n_links for each row of a written table with row numbers."""
    body = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{row}`").alias("row"), F.coalesce(body, F.lit("")).alias("text"))
    rows = staged(signatures(texts), "ngram-rows")
    least = F.min(F.struct("row", "signature", "light"))
    members = rows.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), least.alias("one"))
    members = staged(members.select(F.monotonically_increasing_id().alias("node"), "name", "copies", "first", "one.*"), "ngram-members")

    # only keys that two or more nodes share go on
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keyed = members.select("node", F.explode(band).alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    candidates = staged(keyed.join(crowded, "bucket"), "ngram-candidates")
    light = members.select("node", "light").join(candidates.select("node").distinct(), "node")
    near = in_tiles(tiles(candidates, "bucket", "node", CANDIDATE_BLOCK).join(light, "node"), "a long, b long", _linked)
    joined = components(near, "ngram-near")
    cluster = staged(joined, "ngram-clusters")
    freed(candidates, joined)

    # texts of the clusters' nodes, one of each, for the exact sets; all other texts stay where they are if the rows wanted are few
    chosen = staged(members.select("node", "row", "copies", "light").join(cluster, "node"), "ngram-chosen")
    wanted = chosen.select("row", "node")
    found = texts.select("row", "text").join(F.broadcast(wanted) if wanted.count() <= MOST_ROWS else wanted, "row")
    plain = staged(_sets(found, ["node"]), "ngram-sets")
    size = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sets = plain.join(chosen.drop("row"), "node").join(size, "root")
    verified = staged(in_tiles(tiles(sets, "root", "node", VERIFY_BLOCK), "a long, b long, links long", _verified), "ngram-verified")
    freed(cluster, chosen, plain)
    links = verified.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    root = components(verified.filter("links = 0").select("a", "b"), "ngram-class")
    nodes = members.select("node", "name", "copies", "first").join(root, "node", "left").join(links, "node", "left")
    nodes = staged(nodes.select("name", "copies", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "ngram-nodes")
    # written first, so that a large class and a large group of copies can be split in the joins
    named = staged(nodes.groupBy("root").agg(F.min("first").alias("class_id")), "ngram-named")
    per_name = staged(nodes.join(named, "root").select("name", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "ngram-names")
    freed(members, verified, root, nodes, named)
    all_rows = rows.select("id", "row", "name").join(per_name, "name", "left")
    return all_rows.select("id", "row", "name", "root", F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id, n_links (documents of a similarity of THRESHOLD or more) for each row."""
    docs, row = numbered(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "ngram-texts")
    return classes(docs, row, "text", "id").select(F.col("id").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", left: list[DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one of the smallest id (null last), and one of repeated rows.

    Documents without words stay, each of them.  ``left`` gets the written tables that the result reads, to be freed once it is written.
    """
    columns = docs.columns
    docs, row = numbered(docs, "ngram-docs")
    whole = classes(docs, row, text, key)
    found = staged(whole.select("id", F.col("row").alias(row), "name", "root"), "ngram-found")
    freed(whole)
    named = found.filter("name is not null")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("best")).select(F.col(f"best.{row}").alias(row))
    # rows that go are fewer than those that stay: while they are few, no text leaves its place
    gone = staged(named.select(row).join(best, row, "left_anti"), "ngram-gone")
    freed(found)
    if left is not None:
        left += [docs, gone]
    stay = docs.join(F.broadcast(gone) if gone.count() <= MOST_ROWS else gone, row, "left_anti")
    return stay.select(*[F.col(f"`{c}`") for c in columns])
