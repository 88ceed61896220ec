"""Merkle manifest of a table by superblock reduction.

Every row is a leaf.  The leaves of a group (a language, say) stand in the order of a key and
become a tree: while several nodes remain, every FANOUT consecutive ones become the hash of
their digests (a last run of fewer, even of one, likewise).  The groups' roots, in the order
of the groups, become a tree in the same way.

Places in a group come from a range sort and counts of its runs, so no group meets in one
task.  ``collapsed`` takes buckets of SPAN = FANOUT ** LEVELS consecutive nodes up LEVELS levels at once,
and the buckets' roots are reduced in the same way until each group has one.  Proofs come
down again: a bucket's nodes get their siblings within it, followed by the bucket's own proof.
Only digests move; texts are read once, by the expression that makes the leaves.

Defined results: nulls in any field are encoded as ``-``; a null key stands before all
others and a null group before all others; rows of one key stand in the order of their leaves,
and equal rows each have a place of their own (which of them is which makes no difference); texts of
any length are hashed whole; a lone leaf is its group's root and a lone group's root the
table's, with an empty proof; an empty table gives an empty result; columns are carried
unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import freed, partitions, staged

FANOUT, LEVELS = 8, 3
SPAN = FANOUT**LEVELS
#: Characters of a digest.
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Digest of fields, each ``-`` if null, else its bytes' number, ``:`` and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def depth(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def level_up(digests: list[str]) -> list[str]:
    return [digest("".join(digests[i : i + FANOUT])) for i in range(0, len(digests), FANOUT)]


def siblings(digests: list[str], levels: int) -> list[str]:
    """For each node of a bucket its runs' other digests, level by level."""
    out, at = [""] * len(digests), list(range(len(digests)))
    for _ in range(levels):
        others = []
        for i in range(0, len(digests), FANOUT):
            run = digests[i : i + FANOUT]
            others += ["".join(run[:j] + run[j + 1 :]) for j in range(len(run))]
        out = [s + others[a] for s, a in zip(out, at)]
        at = [a // FANOUT for a in at]
        digests = level_up(digests)
    return out


def folded(leaf: str, places: list[tuple[int, int]], proof: str) -> str:
    """The root that a leaf and a proof lead to; places: (place, nodes) of the leaf in its group, then of the group."""
    used = 0
    for at, of in places:
        while of > 1:
            first = at // FANOUT * FANOUT
            size = HEX * (min(FANOUT, of - first) - 1)
            others, cut = proof[used : used + size], HEX * (at - first)
            leaf = digest(others[:cut] + leaf + others[cut:])
            used, at, of = used + size, at // FANOUT, -(-of // FANOUT)
    return leaf


def folded_root(leaf: Column, at: Column, of: Column, group_at: Column, groups: Column, proof: Column) -> Column:
    """``folded`` as an Arrow function of a manifest's columns."""

    def fold(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([folded(d, [(a, n), (g, m)], p) for d, a, n, g, m, p in zip(*[c.tolist() for c in x])], dtype=str)

    return F.pandas_udf(fold, "string")(leaf, at, of, group_at, groups, proof)


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df``, sorted by ranges and written, with each row's place in its group (``at``, from 0) and the group's rows (``of``)."""
    spark = df.sparkSession
    keys = [*group, *order, "tie"]  # the last one keeps ranges even where rows are equal
    ordered = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    rows = staged(ordered.drop("tie").withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("place", 33))
    runs = rows.groupBy(*group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*group)
    starts = runs.select(*group, "part", "first", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("of"))
    return rows.join(starts, [*group, "part"]).select(*df.columns, (F.col("place") - F.col("first") + F.col("before")).alias("at"), "of")


def collapsed(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Buckets of SPAN nodes (at, of, digest) as a node each."""
    columns = [*group, "at", "of", "digest"]

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        digests, n = rows["digest"].tolist(), int(rows["of"].iat[0])
        for _ in range(min(LEVELS, depth(n))):
            digests, n = level_up(digests), -(-n // FANOUT)
        return rows.iloc[:1].assign(at=rows["at"] // SPAN, of=n, digest=digests[0])[columns]

    bucketed = nodes.select(*columns, F.expr(f"at div {SPAN}").alias("bucket"))
    return bucketed.groupBy(*group, "bucket").applyInPandas(up, nodes.select(*columns).schema)


def rounds(nodes: DataFrame, group: list[str], name: str) -> list[DataFrame]:
    """The nodes, and those of every round of ``collapsed`` until each group has one."""
    out = [nodes]
    most = nodes.agg(F.max("of")).first()[0] or 1
    while most > 1:
        out.append(staged(collapsed(out[-1], group), name))
        most = -(-most // SPAN)
    return out


def with_proofs(nodes: DataFrame, above: DataFrame, group: list[str]) -> DataFrame:
    """``nodes`` with their proofs and what else ``above`` has: (at of the next round, proof, ...)."""
    own = nodes.columns
    more = [c for c in above.columns if c not in (*group, "at", "proof")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*nodes.schema, *above.select("proof", *more).schema])

    def down(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        lower = siblings(rows["digest"].to_pylist(), min(LEVELS, depth(rows["of"][0].as_py())) if rows.num_rows else 0)
        proof = pa.array([s + upper["proof"][0].as_py() for s in lower], pa.string())
        made = [pa.array([upper[c][0].as_py()] * rows.num_rows, upper.schema.field(c).type) for c in more]
        return pa.Table.from_arrays([*[rows[c] for c in own], proof, *made], names=[*own, "proof", *more])

    left = nodes.withColumn("bucket", F.expr(f"at div {SPAN}")).groupBy(*group, "bucket")
    right = above.withColumnRenamed("at", "bucket").groupBy(*group, "bucket")
    return left.cogroup(right).applyInArrow(down, schema)


def proven(levels: list[DataFrame], above: DataFrame, group: list[str], name: str) -> DataFrame:
    """The first round's nodes with their proofs up to what ``above`` says of the last."""
    for nodes in levels[-2:0:-1]:
        above = staged(with_proofs(nodes, above, group).drop("of", "digest"), name)
    return with_proofs(levels[0], above, group) if len(levels) > 1 else levels[0].join(above, [*group, "at"])


def manifest(leaves: DataFrame, leaf: str = "leaf", group: str = "lang", key: str = "doc_id") -> DataFrame:
    """``leaves`` with at, of (place and rows in the group), group_at, groups (the group's place and their number), subroot, root
    and proof (all siblings' digests from the leaf to the root).  A column of the input that has one of these names is left out."""
    made = ["at", "of", "group_at", "groups", "subroot", "root", "proof"]
    carried = [c for c in leaves.columns if c.lower() not in made]
    names = [f"c{i}" for i in range(len(carried))]
    own = ["known", "member"]
    rows = leaves.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.col(f"`{group}`").isNotNull().alias("known"),
        F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")).alias("member"), F.col(f"`{key}`").alias("sort_key"), F.col(f"`{leaf}`").alias("digest"),
    )
    written = staged(rows, "merkle-leaves")  # ranges are sampled: texts are hashed before that
    bottom = placed(written, own, ["sort_key", "digest"], "merkle-placed").drop("sort_key")
    levels = rounds(bottom, own, "merkle-nodes")
    tops = levels[-1].select(*own, F.col("digest"))
    groups = rounds(placed(tops, [], own, "merkle-groups"), [], "merkle-group-nodes")
    root = groups[-1].select("digest").first()
    start = groups[-1].select("at", F.lit("").alias("proof"))
    heads = proven(groups, start, [], "merkle-group-proofs")
    above = heads.select(*own, F.lit(0).cast("long").alias("at"), "proof", F.col("at").alias("group_at"), F.col("of").alias("groups"), F.col("digest").alias("subroot"))
    above = staged(above.withColumn("root", F.lit(root[0] if root else None).cast("string")), "merkle-heads")
    out = proven(levels, above, own, "merkle-proofs")
    freed(written)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carried, names)], *made)
