"""Array expressions that Spark doesn't have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(values: Column) -> Column:
    """An array cut into about as many blocks as each of them has items; of nothing, nothing."""
    size = F.size(values)
    width = F.ceil(F.sqrt(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / width).cast("int") - 1), lambda b: F.slice(values, b * width + 1, width))
    return F.when(size > 0, cut).otherwise(F.slice(F.array(values), F.lit(1), F.lit(0)))


def _totals(values: Column) -> Column:
    """struct(at, out): the sum of a few numbers, and the sums before each."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))


def running(values: Column) -> Column:
    """Sum of the numbers before each one.

    A fold that appends copies what it has, so it runs over blocks, and over the blocks' sums: that copies
    n ** 1.5 numbers, not n ** 2.
    """

    def joined(parts: Column) -> Column:
        starts = _totals(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["out"], lambda x: x + s)))

    return let(values, lambda v: let(F.transform(blocks(v), _totals), joined))
