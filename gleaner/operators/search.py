"""Vector, line and fused search, with their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrays import let, running
from ..functions.text import WHITE_SPACE, snippet, trim_space
from ..functions.vectors import cosine

RRF_K = 60
LINES_PER_FILE = 50
#: Hits that may be broadcast.
MOST_HITS = 10_000


def held(hits: DataFrame, most: int = MOST_HITS) -> tuple[DataFrame, bool]:
    """Hits computed once and kept with the plan, and whether they are; more than ``most`` stay as they are, to be joined by a shuffle."""
    rows = hits.limit(most + 1).collect()
    return (hits, False) if len(rows) > most else (hits.sparkSession.createDataFrame(rows, hits.schema), True)


def vector_top_k(embeddings: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """key, score, rank (from 0): the k nearest by cosine, ties by key; k of 0 or less: all."""
    scored = embeddings.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    order = [F.desc("score"), F.asc(key)]
    hits = scored.orderBy(*order).limit(k) if k > 0 else scored
    return hits.withColumn("rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))


def submatches(line: Column, pattern: str) -> Column:
    """Byte start, byte end and text of every match, from left to right; matches of nothing are left out.

    One pass sets a mark on both sides of every match, of those of nothing too; the mark holds the line's own hash, so no line
    has it.  What stands between marks is then a gap, a match, a gap and so on.
    """
    mark = F.concat(F.lit("\ufdd0"), F.sha1(line.cast("binary")), F.lit("\ufdd0"))
    parts = F.split(F.regexp_replace(line, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark, -1)

    def placed(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda x: F.octet_length(x).cast("long")))
        struct = lambda x, at: F.struct(at.cast("int").alias("start"), (at + F.octet_length(x)).cast("int").alias("end"), x.alias("text"))
        return F.filter(F.zip_with(parts, starts, struct), lambda x, i: (i % 2 == 1) & (x["text"] != ""))

    return let(parts, placed)


def exact_lines(docs: DataFrame, query: str, limit: int, per_file: int = LINES_PER_FILE) -> DataFrame:
    """The first ``limit`` lines, by path, that match a case-insensitive regular expression, at most per_file a file (a row).

    ``submatches`` count bytes of the line as it stands; ``line_text`` is trimmed, by ``lead`` bytes in front.
    """
    pattern = f"(?iu){query}"
    # line by line: over a whole text, anchors and look-around would see what a line doesn't have
    numbered = F.transform(F.split("content", "\n", -1), lambda line, at: F.struct((at + 1).cast("long").alias("line_number"), line.alias("line")))
    own = F.slice(F.filter(numbered, lambda x: x["line"].rlike(pattern)), F.lit(1), F.lit(per_file))
    hits = docs.select(F.col("abs_path").alias("file_path"), "rel_path", "source_name", F.explode(own).alias("x"))
    found = hits.select("file_path", "rel_path", "source_name", "x.line_number", "x.line")
    top = found.select("file_path", "rel_path", "source_name", "line_number", trim_space(F.col("line")).alias("line_text"), "line").orderBy("file_path", "line_number").limit(limit)
    ranked = top.withColumn("rank", (F.row_number().over(W.orderBy("file_path", "line_number")) - 1).cast("int"))
    lead = F.octet_length("line") - F.octet_length(F.ltrim("line", F.lit(WHITE_SPACE)))
    return ranked.withColumns({"submatches": submatches(F.col("line"), pattern), "lead": lead}).drop("line")


def longest_prefix_source(files: DataFrame, sources: DataFrame, path: str = "file_path") -> DataFrame:
    """``files`` with source_name and rel_path of the source whose path is the longest that holds the file; '' and the whole path if none.

    Every directory above a file is looked up by equality, so no pair of file and source is tried in vain.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    listed = files.withColumn("_dir", F.explode(above))
    named = sources.select(F.regexp_replace("path", "/+$", "").alias("_dir"), F.col("name").alias("_name"))
    best = listed.join(named, "_dir").filter(F.col("_dir") != F.col(path)).groupBy(path).agg(F.max(F.struct(F.length("_dir").alias("n"), "_dir", "_name")).alias("_best"))
    joined = files.join(best, path, "left")
    rel = F.when(F.col("_best").isNull(), F.col(path)).otherwise(F.substring(F.col(path), F.col("_best.n") + 2, F.length(path)))
    return joined.select(*[c for c in files.columns if c not in ("source_name", "rel_path")], F.coalesce("_best._name", F.lit("")).alias("source_name"), rel.alias("rel_path"))


def match_to_chunk(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each match (file_path, line_number) with the id of the narrowest chunk that holds its line, or null.

    ``matches`` are a search's, at most its fetch limit, and are broadcast if no more than MOST_HITS.
    """
    matches, few = held(matches)
    keys = matches.select(F.col("file_path").alias("_f"), F.col("line_number").alias("_l")).distinct()
    inside = (F.broadcast(keys) if few else keys).join(chunks, (F.col("file_path") == F.col("_f")) & F.col("_l").between(F.col("start_line"), F.col("end_line")))
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("w"), F.col("start_line").alias("s"), F.col("chunk_index").alias("i"), F.col("id").alias("id"))
    best = inside.groupBy(F.col("_f").alias("file_path"), F.col("_l").alias("line_number")).agg(F.min(rank).alias("_best"))
    return matches.join(best, ["file_path", "line_number"], "left").withColumn("chunk_id", F.col("_best.id")).drop("_best")


def rrf_fuse(semantic: DataFrame, exact: DataFrame, chunks: DataFrame, k: int = RRF_K) -> DataFrame:
    """Rank fusion of hits (chunk_id, rank) and lines (file_path, line_number, line_text, rank, ...).

    Each line adds 1 / (k + rank + 1) to its chunk, every hit once; a chunk's exact_rank is its
    worst line's.  Lines in no chunk are results of their own.
    """
    k = k if k > 0 else RRF_K
    part = lambda r: F.lit(1.0) / (F.lit(k) + r + 1)
    none = F.lit(-1)
    hits = semantic.select(F.col("chunk_id").alias("id"), part(F.col("rank")).alias("part"), F.col("rank").alias("semantic_rank"), none.alias("exact_rank"))
    lines, _ = held(match_to_chunk(exact, chunks))
    inside = lines.filter(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("id"), part(F.col("rank")).alias("part"), none.alias("semantic_rank"), F.col("rank").alias("exact_rank"))
    summed = hits.unionByName(inside).groupBy("id").agg(F.sum("part").alias("score"), F.max("semantic_rank").alias("semantic_rank"), F.max("exact_rank").alias("exact_rank"))
    summed, few = held(summed)
    known = (F.broadcast(summed) if few else summed).join(chunks, "id").select(
        F.col("id").alias("chunk_id"), "file_path", "rel_path", snippet(F.col("content")).alias("snippet"), "score", "semantic_rank", "exact_rank", "source_name", "kind", "language", "title", "start_line", "end_line", "function_name", "section_level"
    )
    outside = lines.filter(F.col("chunk_id").isNull())
    last = outside.groupBy("file_path", "line_number").agg(F.max_by(F.struct("rank", "rel_path", "line_text", "source_name"), "rank").alias("x"))
    empty = F.lit("")
    alone = last.select(
        F.concat(F.lit("exact:"), "file_path", F.lit(":"), F.col("line_number").cast("string")).alias("chunk_id"), "file_path", F.col("x.rel_path").alias("rel_path"), snippet(F.col("x.line_text")).alias("snippet"), part(F.col("x.rank")).alias("score"), none.alias("semantic_rank"),
        F.col("x.rank").alias("exact_rank"), F.col("x.source_name").alias("source_name"), empty.alias("kind"), empty.alias("language"), empty.alias("title"),
        F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), empty.alias("function_name"), F.lit(0).cast("long").alias("section_level"),
    )
    return known.unionByName(alone)


def filtered(results: DataFrame, language: str = "", kind: str = "", directory: str = "", source: str = "") -> DataFrame:
    """Filters on results: language (comma list) and kind regardless of case, a piece of the path, the source's name."""
    if source:
        results = results.filter(F.col("source_name") == source)
    wanted = [x.strip().lower() for x in language.split(",") if x.strip()]
    if wanted:
        results = results.filter(F.lower("language").isin(*wanted))
    if kind:
        results = results.filter(F.lower("kind") == kind.lower())
    if directory:
        results = results.filter(F.col("file_path").contains(directory.rstrip("/") + "/"))
    return results


def semantic_fetch(limit: int) -> int:
    return max(5 * limit, 50)


def hybrid_fetch(limit: int) -> int:
    return max(10 * limit, 100)
