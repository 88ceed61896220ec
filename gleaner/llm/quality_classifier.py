"""Quality classifier by importance resampling.

Two generative models of hashed word runs (one and two words, BUCKETS buckets): one of the
target, the documents labelled good, and one of the raw corpus, all documents.  A document's
importance is the ratio of its likelihoods under the two.  Documents are drawn without
replacement with probabilities that follow the tempered importance, by Gumbel top-k: each
log-weight gets a Gumbel variate from a hash of the row, and the k largest stay.

The sum of the log-ratios of n runs spreads as the root of n, so it is divided by that root
(else length would decide) and by TEMPERATURE, the scale on which draws can overturn weights.
k is the number of documents whose weight reaches what all but a LOSS of the held-out good
documents reach.  The k-th largest value is found exactly, by histograms of bounded size that
narrow it down, never by a sort.

The target model is fitted on a sample of at most about LABELLED good documents; the raw model,
weights, level and draws are over all documents.

Defined results: a null or empty text has weight 0; texts of any length count with all their runs; repeated rows have equal weights and equal
noise; rows that tie at the k-th value all stay; null ids are ids, and never labelled; if no
label is good, all weights are 0 and everything is kept; an empty table gives an empty result;
columns of any other name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import freed, small_batches, staged
from .textnp import flat, runs_hash, word_hashes, words

BUCKETS = 1 << 18
#: A task's histogram is merged in so many slices.
SLICES = 64
#: Occurrences by which a bucket's target count is drawn towards what the raw model expects.  This and the next two
#: were chosen by their results on held-out labels of one table of 10,000 documents.
PRIOR = 10.0
TEMPERATURE = 0.2
LOSS = 0.003
#: About so many good documents, a sample by hash if there are more, fit the target model; their ids are broadcast.
LABELLED = 20_000
#: One in so many good documents, by hash, sets the level instead of training the target model.
HELD_OUT = 4
#: Cells of a histogram that finds the k-th largest value, and rows among which it is picked at last.
CELLS = 1 << 12
FEW = 1000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one and two words, and the text that each is of."""
    data, at = flat(texts)
    start, end, owner = words(data, at)
    values = word_hashes(data, start, end)
    pairs, first = runs_hash(values, owner, 2)
    buckets = np.concatenate([values % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)
    return buckets, np.concatenate([owner, owner[first]])


def counted(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over a column ``text``: tasks send a packed histogram each, in slices, and slices are added up."""
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(features(b.column(0))[0], minlength=BUCKETS)
        own = [k for k in range(SLICES) if total[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in own], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    form = "slice int, counts binary"
    out = np.zeros(BUCKETS)
    for r in texts.mapInArrow(count, form).repartition("slice").mapInArrow(add, form).collect():  # SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-ratio of the two models' probabilities of each bucket; the target model's prior is the raw model,
    so buckets of which too little is known to tell the two apart are level."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def gumbel(*columns: Column) -> Column:
    """A standard Gumbel variate from a hash of the columns."""
    uniform = (F.pmod(F.xxhash64(*columns, F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def weighed(rows: DataFrame, ratio: np.ndarray, text: str) -> DataFrame:
    """``rows`` with log_weight (the sum of the log-ratios by the root of their number) and n_features."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        for b in batches:
            buckets, owner = features(b[text])
            n = np.bincount(owner, minlength=b.num_rows)
            weight = np.bincount(owner, values[buckets], b.num_rows) / np.sqrt(np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(weight), pa.array(n.astype(np.int64))], [*b.schema.names, "log_weight", "n_features"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("log_weight", DoubleType()), StructField("n_features", LongType())]))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, or the least if there are fewer."""
    x = F.col(column)
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if k <= 0 or not n:
        return float("inf")
    k = min(k, n)
    while low < high and n > FEW:
        width = (high - low) / CELLS
        cell = F.least(F.floor((x - low) / width), F.lit(CELLS - 1)) if width > 0 else (x > low).cast("long")
        cells = values.filter((x >= low) & (x <= high)).groupBy(cell.alias("cell")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()  # CELLS rows at most
        for r in sorted(cells, key=lambda r: -r["cell"]):
            n, low, high = r["n"], r["low"], r["high"]
            if k <= n:
                break
            k -= n
    if low == high:
        return low
    return sorted((r[0] for r in values.filter((x >= low) & (x <= high)).select(column).collect()), reverse=True)[k - 1]  # FEW rows at most


def _drawn(docs: DataFrame, labels: DataFrame, text: str, key: str) -> tuple[DataFrame, np.ndarray, float]:
    """id, log_weight, n_features, sample for each row, written; the log-ratios by bucket; and the least sample that stays."""
    small_batches(docs.sparkSession)
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good")).distinct()
    good = staged(good, "quality-good")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = F.pmod(F.xxhash64("good", F.lit("held out")), F.lit(HELD_OUT)) == 0
    fitting = good.filter(~held)
    share = min(1.0, LABELLED / max(1, fitting.count()))
    fitting = fitting.filter(F.pmod(F.xxhash64("good", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(f"`{key}`").alias("id"), body.alias("text"))
    target = counted(texts.join(F.broadcast(fitting), F.col("id") == F.col("good"), "left_semi").select("text"))
    ratio = log_ratio(target, counted(texts.select("text")))
    scored = weighed(docs.select(F.col(f"`{key}`").alias("id"), _noise(text, key), body.alias("text")), ratio, "text")
    rows = staged(scored.select("id", "log_weight", "n_features", _sample().alias("sample")), "quality-weights")
    known = rows.join(good.filter(held), F.col("id") == F.col("good"), "left_semi")
    level = known.agg(F.percentile_approx("log_weight", LOSS, 10_000)).first()[0]
    k = rows.count() if level is None else rows.filter(F.col("log_weight") >= level).count()
    least = kth_largest(rows, "sample", k)
    freed(good)
    return rows, ratio, least


def _noise(text: str, key: str) -> Column:
    return gumbel(F.col(f"`{text}`").cast("string"), F.col(f"`{key}`")).alias("noise")


def _sample() -> Column:
    return F.col("log_weight") / TEMPERATURE + F.col("noise")


def resampled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, log_weight, n_features, sample (tempered weight and noise) and kept for each row."""
    rows, _, least = _drawn(docs, labels, text, key)
    return rows.select(F.col("id").alias(key), "log_weight", "n_features", "sample", (F.col("sample") >= least).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are drawn, unchanged.  They are weighed once more on their way, rather than written or shuffled."""
    drawn, ratio, least = _drawn(docs, labels, text, key)
    freed(drawn)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], _noise(text, key))
    if docs.schema[text].dataType == StringType():
        scored = weighed(rows, ratio, names[docs.columns.index(text)])
    else:
        place = F.col(names[docs.columns.index(text)])
        scored = weighed(rows.withColumn("text", F.coalesce(place.cast("string"), F.lit(""))), ratio, "text")
    return scored.filter(_sample() >= least).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
