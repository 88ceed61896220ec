"""Sharding by balanced label propagation.

Documents are linked if their texts are equal.  Each starts in a shard by the hash of its
id; then, in rounds of Spark joins, linked documents move towards the shard that most of
their neighbours are in, or the next best, as far as that shard's quota lets them, so fewer
links are cut, until nothing moves (documents without links don't count here: they make way later).  Last, quotas are made exact: shards hold row counts that differ by one at most (law ``rows``).

A group of equal texts is never collected: its members move as cohorts (group, shard), found
by aggregation before any shuffle of rows, and ranks within a shard come from bucketed prefix
sums, so no task holds a whole shard or group.  DataFrame functions only.

Defined results: a null text has no bytes (size 1, CRC 0) and counts as equal to an empty
one; texts of any length count whole, by their bytes and hashes, which never leave the first scan; repeated rows are rows of
their own, with slots of their own; a null id is an id; ties fall by hash; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import freed, partitions, prefix_ranks, staged

SHARDS = 16


def flows(wished: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much of what wishes to go from one shard to another may go, so that none takes in more than it gives off and has room for."""
    met = dict(wished)
    over = [sum(n for (_, t), n in met.items() if t == k) - sum(n for (s, _), n in met.items() if s == k) - max(r, 0) for k, r in enumerate(room)]
    while max(over, default=0) > 0:
        t = over.index(max(over))
        for s in sorted((s for s, to in met if to == t), key=lambda s: over[s]):
            less = min(met[s, t], over[t])
            met[s, t] -= less
            over[t] -= less
            over[s] += less
    return met


def started(df: DataFrame, group: list[str], amount: str, buckets: int) -> DataFrame:
    """Column ``start``: what stands before each row in its group if the largest amounts come first, by hash among equals."""
    size_class = F.lit(62) - F.floor(F.log2(F.col(amount).cast("double"))).cast("int")
    df = df.withColumn("bucket", size_class * buckets + F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = df.groupBy(*group, "bucket").agg(F.sum(amount).alias("m")).select(*group, "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    within = W.partitionBy(*group, "bucket").orderBy(F.desc(amount), F.xxhash64("grp"), "grp").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("upto", F.sum(amount).over(within)).join(ahead, [*group, "bucket"])
    return df.withColumn("start", F.col("ahead") + F.col("upto") - F.col(amount)).drop("bucket", "upto", "ahead")


def moved(wishes: DataFrame, met: dict[tuple[int, int], int], n_shards: int, buckets: int) -> DataFrame:
    """Cohorts (grp, shard, n) after ``met`` rows from shard to shard have gone, the largest cohorts first, the last one in part."""
    allowed = F.array(*[F.lit(met.get((s, t), 0)).cast("long") for s in range(n_shards) for t in range(n_shards)])
    some = wishes.filter("want is not null")
    going = started(some, ["shard", "want"], "n", buckets)
    go = F.least(F.col("n"), F.greatest(F.lit(0).cast("long"), F.element_at(allowed, F.col("shard") * n_shards + F.col("want") + 1) - F.col("start")))
    both = F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("want").alias("shard"), F.col("go").alias("n")))
    after = going.withColumn("go", go).select("grp", F.explode(both).alias("x")).select("grp", "x.shard", "x.n").filter("n > 0")
    return after.unionByName(wishes.filter("want is null").select("grp", "shard", "n")).groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def gathered(at: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """Cohorts with ``to``: a shard that has room for the whole of a cut group, else null."""
    whole = at.groupBy("grp").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts")).filter((F.col("parts") > 1) & (F.col("members") <= max(room)))
    to, low = F.lit(None).cast("int"), 0
    for k in sorted((k for k, r in enumerate(room) if r > 0), key=lambda k: (-room[k], k)):
        to = F.when((F.col("start") >= low) & (F.col("start") + F.col("members") <= low + room[k]), F.lit(k)).otherwise(to)
        low += room[k]
    found = started(whole.select("grp", "members"), [], "members", buckets).select("grp", to.alias("to")).filter("to is not null")
    return at.join(found, "grp", "left")


def propagated(at: DataFrame, quota: int, n_shards: int, buckets: int) -> DataFrame:
    """Cohorts (grp, shard, n) after label propagation, which goes on until nothing moves.

    A cohort wishes for the shard of its group's largest cohort (ties: the smallest number) that
    isn't closed; a shard closes when it can't meet all wishes, so those unmet fall on the next
    best in the following round.  Cohorts only go to larger ones, so rounds end.  When none can
    move, cut groups that fit as a whole into the room of another shard go there; after either
    kind of move all shards are open again.
    """
    closed: set[int] = set()
    any_moved = False
    made: list[DataFrame] = []  # written in earlier rounds

    def next_at(df: DataFrame) -> DataFrame:
        out = staged(df, "shard-cohorts")
        freed(*made)
        made[:] = [out]
        return out

    while True:
        order = F.struct("n", (-F.col("shard")).alias("s"))
        best = F.max(F.when(~F.col("shard").isin(*closed), order) if closed else order).over(W.partitionBy("grp"))
        wishes = at.withColumn("best", best).select("grp", "shard", "n", F.when(order < F.col("best"), -F.col("best.s")).alias("want"))
        wishes = staged(wishes, "shard-wishes")
        sums = [tuple(r) for r in wishes.groupBy("shard", "want").agg(F.sum("n")).collect()]  # n_shards * (n_shards + 1) rows at most
        room = [quota - sum(n for s, _, n in sums if s == k) for k in range(n_shards)]
        wished = {(s, t): n for s, t, n in sums if t is not None}
        if wished:
            met = flows(wished, room)
            closed |= {t for (s, t), n in wished.items() if met[s, t] < n}
            if any(met.values()):
                any_moved = True
                at = next_at(moved(wishes, met, n_shards, buckets))
            freed(wishes)
            continue
        freed(wishes)
        if not any_moved:
            if max(room) <= 0:
                return at
            found = staged(gathered(at, room, buckets), "shard-gathered")
            if found.filter("to is not null").limit(1).count() == 0:
                freed(found)
                return at
            at = next_at(found.groupBy("grp", F.coalesce("to", "shard").alias("shard")).agg(F.sum("n").alias("n")))
            freed(found)
        closed, any_moved = set(), False


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size (bytes and one), text_crc32, shard, slot (gapless from 0 in each shard) for each row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.md5(body).alias("grp"))
    rows = staged(rows.withColumn("first", F.pmod(F.xxhash64("id", "grp"), F.lit(n_shards)).cast("int")), "shard-rows")
    first_rows, total = rows, rows.count()
    buckets = max(4, partitions(spark), total // 100_000)

    cohorts = rows.groupBy("grp", "first").agg(F.count(F.lit(1)).alias("n"))
    linked = cohorts.groupBy("grp").agg(F.sum("n").alias("members")).filter("members > 1")
    cohorts = staged(cohorts.join(linked, "grp"), "shard-cohorts")
    at = propagated(cohorts.select("grp", F.col("first").alias("shard"), "n"), total // n_shards, n_shards, buckets)

    # each group's members in the order of ``first``, dealt to its shards one after another
    upto = F.sum("n").over(W.partitionBy("grp").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    ends = at.withColumn("end", upto).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    begin = F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(cohorts.withColumn("begin", begin).join(ends, "grp"), ["grp", "first"], "left")
    salt = lambda n, most: F.pmod(F.xxhash64("id", "size"), F.ceil(F.coalesce(n, F.lit(1)) / most)).cast("int")
    many = prefix_ranks(rows.filter("ends is not null").withColumn("salt", salt(F.col("n"), 20_000)), ["grp", "first"], [F.col("id"), F.col("size")], ["salt"], "nth")
    # linked rows stand before the others in each shard, group by group, so that the others make way
    part = F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int").alias("part")
    held = F.filter("ends", lambda x: x["end"] > F.col("begin") + F.col("nth"))[0]["shard"]
    many = many.select("id", "size", "crc", "grp", held.alias("shard"), F.lit(0).alias("lone"), part, salt(F.col("members"), 2_000).alias("salt"))
    lone = rows.filter("ends is null").select("id", "size", "crc", "grp", F.col("first").alias("shard"), F.lit(1).alias("lone"), part, F.lit(0).alias("salt"))
    rows = staged(prefix_ranks(many.unionByName(lone), ["shard"], [F.col("grp"), F.col("id"), F.col("size")], ["lone", "part", "salt"]), "shard-ranked")
    freed(first_rows, cohorts, at)

    # n_shards rows: how many each holds, may hold, must give and can take
    load = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    load = [load.get(k, 0) for k in range(n_shards)]
    more = set(sorted(range(n_shards), key=lambda k: (-load[k], k))[: total % n_shards])
    full = [total // n_shards + (k in more) for k in range(n_shards)]
    given = taken = 0
    number, to = F.lit(None).cast("long"), []
    for k in range(n_shards):
        if load[k] > full[k]:
            number = F.when((F.col("shard") == k) & (F.col("rank") >= full[k]), F.col("rank") + (given - full[k])).otherwise(number)
            given += load[k] - full[k]
        elif load[k] < full[k]:
            to.append((k, taken, taken + full[k] - load[k]))
            taken += full[k] - load[k]
    target, place = F.col("shard"), F.col("rank")
    for k, low, high in to:
        here = (F.col("number") >= low) & (F.col("number") < high)
        target, place = F.when(here, F.lit(k)).otherwise(target), F.when(here, F.col("number") + (load[k] - low)).otherwise(place)
    rows = rows.withColumn("number", number)
    return rows.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), target.cast("int").alias("shard"), place.cast("long").alias("slot"))
