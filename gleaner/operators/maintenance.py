"""Differences between scans, and merging them into a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source_name", "rel_path"]


def state_diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """source_name, rel_path, status: new, unchanged (time or content as before), changed or deleted."""
    now = current.select(*KEY, F.col("modified_at").alias("_m"), F.col("content_hash").alias("_h"))
    then = state.select(*KEY, F.col("modified_at").alias("_m0"), F.col("content_hash").alias("_h0"), F.lit(True).alias("_old"))
    joined = now.withColumn("_new", F.lit(True)).join(then, KEY, "full_outer")
    same = F.col("_m").eqNullSafe(F.col("_m0")) | F.col("_h").eqNullSafe(F.col("_h0"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return joined.select(*KEY, status.alias("status"))


def expand_state_ids(state: DataFrame, keys: DataFrame) -> DataFrame:
    """chunk_id of all chunks of the files named by ``keys``."""
    return state.join(keys.select(*KEY), KEY, "left_semi").select(F.explode("chunk_ids").alias("chunk_id")).distinct()


def files_to_process(current: DataFrame, diff: DataFrame) -> DataFrame:
    return current.join(diff.filter(F.col("status").isin("new", "changed")), KEY, "left_semi")


def remove_chunks(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("chunk_id").alias(column)), column, "left_anti")


def merge_rows(old: DataFrame, new: DataFrame, column: str = "id") -> DataFrame:
    """Old and new rows; an id of both is the new one's."""
    return old.join(new.select(column), column, "left_anti").unionByName(new)


def records_by_file(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """State rows: each document with the ids of its chunks in order (none: an empty list)."""
    ids = chunks.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    joined = docs.join(ids, KEY, "left")
    return joined.select(*KEY, "content_hash", "modified_at", "byte_size", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def files_by_time(files: DataFrame, state: DataFrame) -> DataFrame:
    """Listed files with ``same``: whether the state has them with their time, so that nobody need read them."""
    then = state.select(*KEY, F.col("modified_at").alias("_m0"), F.lit(True).alias("_old"))
    return files.join(then, KEY, "left").withColumn("same", F.coalesce(F.col("_old") & F.col("modified_at").eqNullSafe(F.col("_m0")), F.lit(False))).drop("_m0", "_old")


def listed_diff(files: DataFrame, read: DataFrame, state: DataFrame) -> DataFrame:
    """``state_diff`` from a listing with ``same`` and the documents read of those that aren't."""
    read = read.select(*KEY, "modified_at", "content_hash")
    known = files.filter("same").select(*KEY).join(state.select(*KEY, "modified_at", "content_hash"), KEY)
    return state_diff(read.unionByName(known), state)


def records_of_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """State rows of listed files from their chunks; files without chunks are there if they are empty (others aren't text)."""
    own = chunks.groupBy(*KEY).agg(F.first("content_hash").alias("content_hash"), F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    joined = files.join(own, KEY, "left").filter(F.col("chunk_ids").isNotNull() | (F.col("byte_size") == 0))
    return joined.select(*KEY, F.coalesce("content_hash", F.sha1(F.lit("").cast("binary"))).alias("content_hash"), "modified_at", "byte_size", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def update_state(state: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """State without deleted and changed files, and with the fresh rows; touched but unchanged files keep their old time."""
    gone = diff.filter(F.col("status").isin("deleted", "changed"))
    kept = state.join(gone, KEY, "left_anti").join(fresh.select(*KEY), KEY, "left_anti")
    return kept.unionByName(fresh)


def count_files_per_source(state: DataFrame, sources: DataFrame) -> DataFrame:
    """name, enabled, files of each source (0 without any)."""
    counts = state.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    return sources.select("name", "enabled").join(counts, "name", "left").select("name", "enabled", F.coalesce("files", F.lit(0)).alias("files"))
