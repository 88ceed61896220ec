"""Hard negatives by branch and bound over ball trees.

Rows are dealt into cells around centres (rows of a bounded sample: at most CELLS of them), and
a cell's rows into blocks of bounded size.  In a block a ball tree bounds the inner products
of an anchor with all rows of a node from above and below: a . c +- |a| r.  A node goes if it
lies outside the anchor's score windows, strictly beneath its current k-th score, or holds no row of
a label that counts.  The cells themselves are the trees' upper level: an anchor first
searches its nearest cell, and then only those cells that its windows and the scores found so far leave.

Two searches run so: the k nearest rows of an anchor's own label, its positives; then, for
each positive, the nearest rows of other labels whose score lies between two percentages of
the positive's.  Components become floor(SCALE * x), so scores are integers and exact; where
doubles could round them, Python's integers count.

Every pair that can matter is searched, so results are those of brute force.  A vector and
label that many rows share is one candidate of a block with as many of its smallest ids as any
anchor can need.

Defined results: rows with a null id, label or vector, or with a component that is null or
not finite once scaled, take no part; zero and empty vectors do, and vectors of different lengths never
meet; repeated rows count as rows, repeated anchors as one; an anchor's other rows are those of
other ids, negatives are any rows of another label; an anchor id with several vectors or labels is mined
for each; ties go to the smaller id; scores beyond a long are held at its ends; an empty table gives an empty
result; columns other than id, label and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .common import freed, small_batches, staged

SCALE = 256
#: Cells at most, numbers that a cell is made for, numbers in a block of rows and in one of anchors.
CELLS, CELL_VALUES, BLOCK_VALUES, ANCHOR_VALUES = 1024, 1 << 18, 1 << 22, 1 << 19
#: Rows of a leaf, anchors scored at once.
LEAF, TOGETHER = 128, 2048
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def codes(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Scaled components, as doubles that are whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(len(column), dim) + 0.0


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exact."""
    most = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, LEAST, GREATEST).astype(np.int64)


def percent(p: np.ndarray, share: int, up: bool) -> np.ndarray:
    """share per cent of p, rounded up or down, without overflow."""
    whole, rest = np.divmod(-p if up else p, 100)
    out = whole * share + rest * share // 100
    return -out if up else out


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Places, from 0, within runs of equal rows of sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def needed(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Rows that any anchor can need: of equal vectors and labels the 2 k smallest ids, of one id k times at most."""
    if x.shape[1]:
        which = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
    else:
        which = np.zeros(len(x), np.int64)
    order = np.lexsort((ids, labels, which))
    order = order[ranks(which[order], labels[order], ids[order]) < k]
    return order[ranks(which[order], labels[order]) < 2 * k]


def cut_at(along: np.ndarray) -> int:
    """Where to cut sorted values: in a wide gap that leaves a sixteenth on each side, else in the middle."""
    n = len(along)
    edge = n // 16
    gaps = np.diff(along[edge : n - edge])
    widest = int(gaps.argmax())
    return edge + widest + 1 if 10 * gaps[widest] >= along[-1] - along[0] > 0 else n // 2


class BallTree:
    """Nodes over the rows of ``x``, which are put in the leaves' order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.arange(len(x))
        self.spans, self.children, centres, self.radii, self.kinds = [], [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            own = x[order[low:high]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            if parent >= 0:
                self.children[parent][side] = len(self.spans)
            here = len(self.spans)
            self.spans.append((low, high))
            self.children.append([-1, -1])
            centres.append(centre)
            self.radii.append(float(far.max()))
            self.kinds.append((labels[order[low:high]].min(), labels[order[low:high]].max()))
            if high - low > LEAF and self.radii[here] > 0:
                one = own[far.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                along = own @ (other - one)
                along_order = np.argsort(along, kind="stable")
                order[low:high] = order[low:high][along_order]
                cut = low + cut_at(along[along_order])
                stack += [(low, cut, here, 0), (cut, high, here, 1)]
        self.centres = np.array(centres)
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]


def bounds(a: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of anchors with what lies in a ball, with room for rounding."""
    dot, wide = a @ centre, norm * (radius + 1e-9 * (radius + np.sqrt((centre**2).sum())))
    return dot - wide, dot + wide


class Found:
    """The k best (score, id) of each anchor's windows, and the scores that a row must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        n, windows = floor.shape
        self.k, self.floor = k, floor.copy()
        self.score, self.id = np.full((n, windows, k), LEAST), np.zeros((n, windows, k), np.int64)
        self.count = np.zeros((n, windows), np.int64)

    def add(self, window: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old = np.unique(anchor)
        at, place = np.nonzero(np.arange(self.k) < self.count[old, window, None])
        anchor = np.concatenate([old[at], anchor])
        score = np.concatenate([self.score[old[at], window, place], score])
        ids = np.concatenate([self.id[old[at], window, place], ids])
        order = np.lexsort((ids, ~score, anchor))
        place = ranks(anchor[order])
        order, place = order[place < self.k], place[place < self.k]
        self.score[anchor[order], window, place], self.id[anchor[order], window, place] = score[order], ids[order]
        np.maximum.at(self.count, (anchor[order], window), place + 1)
        full = old[self.count[old, window] == self.k]
        self.floor[full, window] = np.maximum(self.floor[full, window], self.score[full, window, self.k - 1])


def search(a: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, low: np.ndarray, high: np.ndarray, tree: BallTree, k: int, same: bool) -> Found:
    """Branch and bound for many anchors at once; low, high: the scores that count, by anchor and window."""
    found = Found(low, k)
    norm = np.sqrt((a**2).sum(axis=1))

    def scan(node: int, who: np.ndarray) -> None:
        rows = slice(*tree.spans[node])
        scores = products(a[who], tree.x[rows])
        counts = (tree.labels[rows] == own_labels[who, None]) == same
        if same:
            counts &= tree.ids[rows] != own_ids[who, None]
        for j in range(low.shape[1]):
            good = counts & (scores >= found.floor[who, j, None]) & (scores <= high[who, j, None])
            if good.shape[1] > k:
                least = np.partition(np.where(good, scores, LEAST), -k, axis=1)[:, -k, None]
                good &= scores >= least
            at, row = np.nonzero(good)
            if len(at):
                found.add(j, who[at], scores[at, row], tree.ids[rows][row])

    stack = [(0, who) for who in np.split(np.arange(len(a)), range(TOGETHER, len(a), TOGETHER))]
    while stack:
        node, who = stack.pop()
        least, most = bounds(a[who], norm[who], tree.centres[node], tree.radii[node])
        alive = ((most[:, None] >= found.floor[who]) & (least[:, None] <= high[who])).any(axis=1)
        first, last = tree.kinds[node]
        alive &= ((own_labels[who] >= first) & (own_labels[who] <= last)) if same else ~((own_labels[who] == first) & (first == last))
        who = who[alive]
        if not len(who):
            continue
        left, right = tree.children[node]
        if left < 0:
            scan(node, who)
            continue
        lefts = a[who] @ (tree.centres[left] - tree.centres[right]) >= 0
        stack += [(left, who[~lefts]), (right, who), (left, who[lefts])]  # the last goes first: each anchor's better side before the other
    return found


def windows(units: pa.Table, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores that count, by anchor and window; a search for positives has one without bounds, missing windows hold nothing."""
    given, kth = units["ps"].to_pylist(), units["kth"].to_pylist()
    n, wide = len(given), max((len(p) for p in given if p is not None), default=1)
    least, most = np.full((n, wide), GREATEST), np.full((n, wide), LEAST)
    for i, (p, reached) in enumerate(zip(given, kth)):
        if p is None:
            least[i, 0], most[i, 0] = LEAST, GREATEST
        else:
            own = np.array(p, np.int64)
            least[i, : len(p)], most[i, : len(p)] = percent(own, low, True), percent(own, high, False)
        for j, s in enumerate(reached or []):
            if s is not None:
                least[i, j] = max(least[i, j], s)
    return least, most


class Cells:
    """Centres and radii of the cells by length of vectors: at most CELLS and one for each length."""

    def __init__(self, table: DataFrame, centres: dict[int, np.ndarray]):
        stats = table.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
        self.rows = [(r["dim"], r["cell"], max(1, -(-r["n"] * r["dim"] // BLOCK_VALUES))) for r in stats]
        self.table = table
        self.balls = {}
        for dim in {r["dim"] for r in stats}:
            own = [r for r in stats if r["dim"] == dim]
            at = np.array([r["cell"] for r in own])
            self.balls[dim] = (at, centres.get(dim, np.zeros((1, dim)))[at], np.array([r["far"] for r in own]))


def dealt(vectors: DataFrame, values: int) -> Cells:
    """Every row with the nearest centre (those of its length; the origin if there is none) and its distance."""
    n = min(CELLS, max(1, values // CELL_VALUES))
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(n).select("dim", "v").collect()
    centres = {d: np.unique(np.floor(SCALE * np.array([r["v"] for r in sample if r["dim"] == d])) + 0.0, axis=0) for d in {r["dim"] for r in sample} if d}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == d))
                x, c = codes(some["v"], d), centres.get(d, np.zeros((1, d)))
                cell = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
                far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(far)], [*some.schema.names, "cell", "far"])

    return Cells(staged(vectors.mapInArrow(near, StructType([*vectors.schema, StructField("cell", IntegerType()), StructField("far", DoubleType())])), "negatives-cells"), centres)


def routed(units: DataFrame, cells: Cells, low: int, high: int, home: bool) -> DataFrame:
    """Anchors with the cells to search: the nearest one, or all others that their windows and scores leave."""
    balls = cells.balls

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                if d not in balls:
                    continue
                some = b.filter(pa.array(dims == d))
                at, centres, radii = balls[d]
                a = codes(some["v"], d)
                norm = np.sqrt((a**2).sum(axis=1))
                first = (a @ centres.T).argmax(axis=1)
                wanted = np.zeros((len(a), len(at)), bool)
                if home:
                    wanted[np.arange(len(a)), first] = True
                else:
                    floor, top = windows(pa.Table.from_batches([some]), low, high)
                    for j in range(len(at)):
                        least, most = bounds(a, norm, centres[j], radii[j])
                        wanted[:, j] = ((most[:, None] >= floor) & (least[:, None] <= top)).any(axis=1) & (first != j)
                row, ball = np.nonzero(wanted)
                out = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at[ball], pa.int32())], [*out.schema.names, "cell"])

    return units.mapInArrow(route, StructType([*units.schema, StructField("cell", IntegerType())]))


def searched(routes: DataFrame, cells: Cells, k: int, low: int, high: int, same: bool) -> DataFrame:
    """a, j, id, score: the k best of each block for each anchor and window."""
    spark = routes.sparkSession
    routes = staged(routes, "negatives-routes")
    anchors = {(r["dim"], r["cell"]): r["n"] for r in routes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(d, c, salts, max(1, -(-anchors[d, c] * d // ANCHOR_VALUES))) for d, c, salts in cells.rows if (d, c) in anchors]
    blocks = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, salts long, parts long"))  # as many rows as cells
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = cells.table.drop("far").join(blocks, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts"))).withColumn("part", each("parts")).drop("salts", "parts")
    units = routes.join(blocks, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).withColumn("salt", each("salts")).drop("salts", "parts")
    on = ["dim", "cell", "salt", "part"]

    def block(units: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if units.num_rows and rows.num_rows:
            dim = units["dim"][0].as_py()
            x, ids, labels = codes(rows["v"], dim), rows["id"].to_numpy(), rows["label"].to_numpy()
            some = needed(x, ids, labels, k)
            tree = BallTree(x[some], ids[some], labels[some])
            found = search(codes(units["v"], dim), units["id"].to_numpy(), units["label"].to_numpy(), *windows(units, low, high), tree, k, same)
            unit, window, place = np.nonzero(np.arange(k) < found.count[:, :, None])
            out = [units["a"].to_numpy()[unit], window, found.id[unit, window, place], found.score[unit, window, place]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["a", "j", "id", "score"])

    return units.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(block, "a long, j int, id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("a", "j").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(units: DataFrame, cells: Cells, k: int, low: int, high: int, same: bool) -> DataFrame:
    """a, j, rank, id, score: first in the nearest cells, then in those that are left."""
    found = searched(routed(units, cells, low, high, True), cells, k, low, high, same)
    if len(cells.rows) == 1:
        return best(found, k)
    found = staged(best(found, k).drop("rank"), "negatives-near")
    reached = found.groupBy("a", "j").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    reached = reached.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("j", "least"))).alias("m"))
    kth = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.coalesce("ps", F.array(F.lit(0).cast("long")))), F.lit(1)) - 1), lambda j: F.col("m")[j])
    units = units.drop("kth").join(reached, "a", "left").withColumn("kth", F.when(F.col("m").isNotNull(), kth)).select(*units.columns)
    return best(found.unionByName(searched(routed(units, cells, low, high, False), cells, k, low, high, same)), k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of ``anchors`` and each of its
    nearest rows of its label in ``vectors`` the nearest rows of other labels with low to high per cent of the positive's score."""
    small_batches(vectors.sparkSession)
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))

    def pick(df: DataFrame) -> DataFrame:
        own = F.col(f"`{vector}`")
        own = own if df.schema[vector].dataType == ArrayType(FloatType()) else own.cast("array<double>")  # half the bytes on their way
        named = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), own.alias("v"))
        return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole).withColumn("dim", F.size("v"))

    rows = pick(vectors)
    values = rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    cells = dealt(rows, values)
    none = F.lit(None).cast("array<long>")
    units = staged(pick(anchors).distinct().select(F.monotonically_increasing_id().alias("a"), "id", "label", "v", "dim", none.alias("ps"), none.alias("kth")), "negatives-anchors")
    near = mined(units, cells, positives, low, high, True)
    listed = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("x"))
    paired = staged(units.drop("ps").join(listed, "a").withColumn("ps", F.transform("x", lambda p: p["score"])).withColumn("pi", F.transform("x", lambda p: p["id"])).drop("x"), "negatives-positives")
    found = staged(mined(paired.select(*units.columns), cells, negatives, low, high, False), "negatives-found")
    freed(cells.table, units)
    named = found.join(paired.select("a", F.col("id").alias("anchor_id"), "ps", "pi"), "a")
    return named.select("anchor_id", F.get("pi", F.col("j")).alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.get("ps", F.col("j")).alias("positive_score"), F.col("score").alias("negative_score"))
