"""Best-fit packing of documents into token sequences by linear grouping.

Only lengths matter for a packing, and there are at most ``capacity`` of them, so a plan is
made on the driver from the histogram of lengths (a table whose size the capacity bounds):

1. large lengths are ordered and cut into groups of equal numbers of pieces, and each length
   is rounded up to its group's largest;
2. over these few sizes a linear programme finds which configurations (multisets of sizes
   that fit) to use how often, new configurations coming from a knapsack (column generation);
3. actual pieces take the places of rounded ones, which leaves room;
4. what rounding down the programme's solution left over, and then all small pieces, go by
   best fit, largest first, into the fullest sequence that has room.

A plan is a list of runs, "so many sequences that hold these lengths", never of sequences.
In Spark each piece gets its number among the pieces of its length (bucketed prefix sums)
and finds its run by binary search.

Defined results: a null or empty text is the end token alone; texts of any length are encoded whole, in stretches cut between
words; repeated rows and null ids are
packed as rows of their own; equal lengths are interchangeable; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import partitions, prefix_ranks, small_batches, staged

CAPACITY = 2048
END = 0
GROUPS = 192
#: Lengths above this share of the capacity are large; the plan with the fewest sequences is taken.
LARGE = (1 / 4, 1 / 2)


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often to use them, covering no more than counts.

    Column generation: the simplex basis starts with one size a configuration; the dual
    prices feed a knapsack, whose best configuration enters while it costs less than it is worth.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ counts
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        column, worth = knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        along = inverse @ column
        ratio = np.where(along > 1e-9, amount / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        amount = amount - step * along
        amount[out] = step
        basis[:, out] = column
        inverse[out] /= along[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(along[others], inverse[out])
    whole = np.maximum(np.floor(amount + 1e-6), 0).astype(np.int64)
    left = counts.astype(np.int64).copy()
    plan = []
    for j in np.argsort(-whole, kind="stable"):
        config = np.rint(basis[:, j]).astype(np.int64)
        used = config > 0
        times = int(min(whole[j], (left[used] // config[used]).min())) if used.any() else 0
        if times:
            left -= times * config
            plan.append((config, times))
    return plan


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration worth most at these prices."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i in np.argsort(-price / sizes):
        s, p = int(sizes[i]), price[i]
        if p <= 0:
            continue
        for _ in range(capacity // s):
            offer = best[:-s] + p
            better = offer > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, offer, best[s:])
            last[s:] = np.where(better, i, last[s:])
    column, room = np.zeros(len(sizes)), int(np.argmax(best))
    worth = best[room]
    while room > 0 and last[room] >= 0:
        column[last[room]] += 1
        room -= int(sizes[last[room]])
    return column, float(min(worth, price @ column))


class Supply:
    """The pieces of each length, handed out by number from 0."""

    def __init__(self, histogram: dict[int, int]):
        self.left, self.next = dict(histogram), dict.fromkeys(histogram, 0)

    def take(self, size: int, n: int) -> int:
        first = self.next[size]
        self.next[size] += n
        self.left[size] -= n
        return first


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """The shortest of the plans by each share of LARGE."""
    return min((plan_by(share, histogram, capacity, groups) for share in LARGE), key=lambda runs: sum(n for n, _ in runs))


def plan_by(large_share: float, histogram: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of sequences, [(length, first piece's number), ...]): sequence j of a run holds, of each
    length listed, the piece of that number plus j."""
    supply = Supply(histogram)
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    for size in [s for s in histogram if s >= capacity]:
        runs.append((histogram[size], [(size, supply.take(size, histogram[size]))]))
    large = sorted((s for s in histogram if capacity * large_share < s < capacity), reverse=True)
    if large:
        total = sum(histogram[s] for s in large)
        share = max(1, -(-total // groups))
        members: list[list[int]] = []
        held = share
        for s in large:  # a length is in one group, so groups are equal up to one length's pieces
            if held >= share:
                members.append([])
                held = 0
            members[-1].append(s)
            held += histogram[s]
        sizes = np.array([m[0] for m in members])
        counts = np.array([sum(histogram[s] for s in m) for m in members], float)
        for config, times in configurations(sizes, counts, capacity):
            places = [g for g in np.flatnonzero(config).tolist() for _ in range(config[g])]
            runs += substituted(places, times, members, supply)
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sorted_rooms: list[int] = []
    done = []

    def put(n: int, held: list[tuple[int, int]]) -> None:
        room = capacity - sum(s for s, _ in held)
        if room <= 0:
            done.append((n, held))
            return
        if room not in rooms:
            rooms[room] = []
            insort(sorted_rooms, room)
        rooms[room].append((n, held))

    for n, held in runs:
        put(n, held) if held[0][0] < capacity else done.append((n, held))
    for size in sorted((s for s in supply.left if supply.left[s] and s < capacity), reverse=True):
        while n := supply.left[size]:
            at = bisect_left(sorted_rooms, size)
            room = sorted_rooms[at] if at < len(sorted_rooms) else capacity
            if at < len(sorted_rooms):
                count, held = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sorted_rooms[at]
            else:
                count, held = n, []  # as many new sequences as may be needed
            each = min(room // size, n)
            used = min(count, n // each)
            if count > used and held:
                put(count - used, [(s, first + used) for s, first in held])
            # slot by slot, so that each slot of the run holds consecutive numbers
            put(used, held + [(size, supply.take(size, used)) for _ in range(each)])
    return done + [run for of in rooms.values() for run in of]


def substituted(places: list[int], times: int, members: list[list[int]], supply: Supply) -> list[tuple[int, list[tuple[int, int]]]]:
    """``times`` sequences with a piece of these groups at each place, as runs of equal actual lengths."""
    columns = []
    for g in places:
        column, need = [], times
        for s in members[g]:
            if need and supply.left[s]:
                n = min(need, supply.left[s])
                column.append([n, s, supply.take(s, n)])
                need -= n
        columns.append(column)
    runs = []
    while columns[0]:
        n = min(c[0][0] for c in columns)
        runs.append((n, [(c[0][1], c[0][2]) for c in columns]))
        for c in columns:
            c[0][0] -= n
            c[0][2] += n
            if not c[0][0]:
                c.pop(0)
    return runs


def located(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first piece numbers, in order, with the sequence and the offset they go to."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for n, held in runs:
        offset = 0
        for size, first in held:
            at.setdefault(size, []).append((first, sequence, offset))
            offset += size
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) for s, rows in at.items()}


def pieces_of(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids): documents as ids with END after them, cut only if longer than capacity."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.uint32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path).encode
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text), np.array([END], "<u4")).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for p, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[low:high]
                    for column, x in zip(out, (i, p, low, high - low, zlib.crc32(own.tobytes()), own)):
                        column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([a.cast(pa.list_(pa.int64())) if t == types[5] else a for a, t in zip(arrays, types)], names)

    return source.mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The columns of pieces_of, then sequence_id and offset."""
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, vocabulary_path, capacity, text, key, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    where = located(plan_packing(histogram, capacity))
    buckets = max(2, partitions(spark), sum(histogram.values()) // 100_000)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    numbered = prefix_ranks(dealt, ["length"], [F.col(f"`{key}`"), F.col("piece"), F.col("ids_crc32")], ["_bucket"], "_number").drop("_bucket")
    shared = spark.sparkContext.broadcast(where)  # its size follows from the capacity and the groups

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            t = pa.Table.from_batches([b])
            lengths, numbers = t["length"].to_numpy(), t["_number"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                firsts, sequences, offsets = plan[size]
                run = np.searchsorted(firsts, numbers[own], "right") - 1
                sequence[own], offset[own] = sequences[run] + numbers[own] - firsts[run], offsets[run]
            t = t.drop_columns(["_number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.to_batches()

    from pyspark.sql import types as T

    schema = T.StructType([f for f in numbered.schema.fields if f.name != "_number"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)
