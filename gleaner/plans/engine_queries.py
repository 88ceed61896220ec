"""Registered queries that go through the engine, a bundle or a scan as a whole, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..functions.catalog import MODELS, QUERY_PREFIX
from ..functions.registered import register_chunks, register_embed
from ..functions.wordpiece import WordPiece, hashed_ids, plain, pre_tokenize
from ..operators import cells, trigrams
from ..operators import search as s
from ..operators.chunking import Chunking, build_chunks, code_boundaries
from ..sources.scan import Source, scan_sources, table_documents
from ..sources.shared import small_batches
from . import output
from .config import Config
from .engine import Engine
from .queries import BOUNDS, CODE, DOCS, FNV, HEADS, HITS, LIMIT, LINES, MARKDOWN, MATCHED, SMALL, _code, _markdown, _query, _vectors, TERM, TEXT_CHUNKS, before, chunk_sql, documents, exact_sql, now, read, work_dir

QUESTION = "secret of the river"


def engine(spark: SparkSession, docs: DataFrame, **settings) -> Engine:
    """An engine whose bundle holds a table's documents."""
    out = Engine(spark, Config(work_dir(spark), **settings))
    out.bundle.initialize(out.model)
    out.rebuild(docs)
    return out


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "benchmark").select("item_id", F.concat(F.lit("note"), (F.col("item_id") % 2).cast("string")).alias("source"), "text")
    return table_documents(items, key="item_id").withColumn("content_hash", t.content_hash(F.col("content")))


def _notebook(spark: SparkSession, sf: str) -> Engine:
    return engine(spark, _notes(spark, sf), chunking=Chunking(300, 50, 20))


# -- index, sync and what a bundle holds --------------------------------------------


def engine_index(spark, sf):
    return engine(spark, now(spark, sf)).bundle.chunks().select("id", "rel_path", "chunk_index", "content", "start_line", "end_line", "kind", "language", "title", "headings_json", "byte_size", "content_hash")


def engine_state(spark, sf):
    return engine(spark, now(spark, sf)).bundle.state().select("source_name", "rel_path", "content_hash", "byte_size", F.size("chunk_ids").cast("long").alias("chunks"), F.get("chunk_ids", F.lit(0)).alias("first"))


def engine_totals(spark, sf):
    done = engine(spark, now(spark, sf), sources=[Source("src0", "/src0"), Source("src1", "/src1", enabled=False)])
    status = done.status()
    return spark.createDataFrame([(status["files"], status["chunks"], status["embeddings"], len(status["sources"]), status["sources"][0][1], status["state"])], "files long, chunks long, embeddings long, sources long, first_files long, state string")


def engine_embeddings(spark, sf):
    vectors = _notebook(spark, sf).bundle.embeddings()
    each = vectors.select("chunk_id", F.posexplode("vector").alias("slot", "x")).filter("x <> 0")
    return each.select("chunk_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 5).alias("x"))


def engine_sync(spark, sf):
    """What was indexed of an earlier state is brought up to date."""
    done, docs = _synced(spark, sf)
    done.sync(docs)
    return done.bundle.chunks().select("id", "rel_path", "chunk_index", "start_line", "end_line")


def engine_sync_counts(spark, sf):
    done, docs = _synced(spark, sf)
    found = done.sync(docs)
    return spark.createDataFrame([tuple(found[k] for k in ("new", "changed", "deleted", "unchanged"))], "new long, changed long, deleted long, unchanged long")


def _synced(spark: SparkSession, sf: str) -> tuple[Engine, DataFrame]:
    docs = now(spark, sf)
    # texts of files that have changed since had another beginning; they come with the state, since a join would move all of them
    earlier = before(spark, sf, "content").drop("chunk_ids").withColumnRenamed("content_hash", "old_hash")
    body = F.when(F.col("old_hash") == "x", F.concat(F.lit("old words\n"), "content")).otherwise(F.coalesce("content", F.lit("gone")))
    path = F.concat(F.lit("/"), "source_name")
    earlier = earlier.select("source_name", path.alias("source_path"), F.concat(path, F.lit("/"), "rel_path").alias("abs_path"), "rel_path", F.lit("txt").alias("extension"), body.alias("content"), "byte_size", "modified_at")
    return engine(spark, earlier.withColumn("content_hash", t.content_hash(F.col("content")))), docs


def engine_sync_one_source(spark, sf):
    """A sync of one source leaves what other sources hold."""
    done, docs = _synced(spark, sf)
    done.sync(docs.filter("source_name = 'src0'"), only="src0")
    return done.bundle.state().select("source_name", "rel_path", "content_hash")


# -- search through the engine ----------------------------------------------------------


def engine_search_semantic(spark, sf):
    found = _notebook(spark, sf).search(QUESTION, "semantic", limit=15)
    return found.select("chunk_id", "file_path", F.round("score", 4).alias("score"), "semantic_rank", "exact_rank", "source_name", "kind", "start_line")


def engine_search_exact(spark, sf):
    found = _notebook(spark, sf).search("(the|of) [a-z]", "exact", limit=12, source="note1", documents=_notes(spark, sf))
    return found.select("chunk_id", "file_path", "snippet", "score", "semantic_rank", "exact_rank", "source_name", "kind", "start_line", "end_line")


def engine_search_hybrid(spark, sf):
    found = _notebook(spark, sf).search("the", "hybrid", limit=20, kind="TEXT", documents=_notes(spark, sf))
    return found.select("chunk_id", "file_path", F.round("score", 9).alias("score"), "semantic_rank", "exact_rank", "source_name")


def engine_search_prefiltered(spark, sf):
    found = _notebook(spark, sf).search(QUESTION, "semantic", limit=0, directory="note0/", prefilter=True)
    return found.select("chunk_id", F.round("score", 4).alias("score"))


def exact_cap_of_fifty(spark, sf):
    files = read(spark, sf, "part").groupBy(F.lit("parts").alias("source"), F.expr("p_partkey % 10").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("x "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))), "\n").alias("text"))
    return s.exact_lines(table_documents(files, key="k"), "X ", 10_000).select("file_path", "line_number", "rank")


def rrf_synthetic(spark, sf):
    """Lines of files without chunks are results of their own."""
    docs = documents(spark, sf)
    chunks = build_chunks(docs.filter(F.regexp_extract("rel_path", r"(\d+)", 1).cast("long") % 2 == 0))
    none = chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("rank")).filter("false")
    return s.rrf_fuse(none, s.exact_lines(docs, TERM, 500), chunks).select("chunk_id", F.round("score", 9).alias("score"), "semantic_rank", "exact_rank", "source_name")


def highlight(spark, sf):
    """Lines, marked as output for people marks them."""
    found = s.exact_lines(documents(spark, sf), TERM, 500)
    place = lambda side: F.transform("submatches", lambda x: x[side] - F.col("lead"))

    def mark(lines: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        at = lambda text, n: len(text.encode()[:n].decode(errors="ignore"))
        return pd.Series([output.highlight(x, [(at(x, a), at(x, b)) for a, b in zip(low, high)]) for x, low, high in zip(lines, starts, ends)], dtype=str)

    return found.select("file_path", "line_number", F.pandas_udf(mark, "string")("line_text", place("start"), place("end")).alias("marked"))


def exact_submatches_empty(spark, sf):
    """Places of an expression that matches nothing almost everywhere."""
    found = s.exact_lines(documents(spark, sf), "e*", LIMIT).select("file_path", "line_number", F.posexplode("submatches").alias("n", "x"))
    return found.select("file_path", "line_number", "n", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def exact_lines_indexed(spark, sf):
    """Lines of the texts that posting lists let through."""
    docs, path = documents(spark, sf), f"{work_dir(spark)}/grams"
    trigrams.postings(docs).write.parquet(path)
    some = trigrams.worth_searching(docs.withColumn("same", F.lit(True)), "same", spark.read.parquet(path), trigrams.condition(TERM))
    return s.exact_lines(some, TERM, LIMIT).drop("submatches", "rel_path", "lead")


def vector_top_k_cells(spark, sf):
    """The nearest vectors, from the cells that can hold them."""
    vectors, path = _vectors(spark, sf), f"{work_dir(spark)}/cells"
    centres = cells.centres_of([r["vector"] for r in vectors.orderBy(F.xxhash64("chunk_id")).limit(16).select("vector").collect()], 16)
    cells.with_cells(vectors, centres).write.partitionBy("cell").parquet(path)
    written = spark.read.parquet(path)
    read = lambda some: written.filter(F.col("cell").isin([c["cell"] for c in some]))
    found, _ = cells.top_k_by_cells(read, cells.cells_of(written, centres).collect(), _query(spark, sf), 50)
    return found.select("chunk_id", F.round(F.col("score").cast("double"), 5).alias("score"), "rank")


def chunks_in_sql(spark, sf):
    """The table function over markdown and code."""
    register_chunks(spark, "chunks", SMALL)
    both = _markdown(spark, sf).unionByName(_code(spark, sf))
    both.createOrReplaceTempView("gleaner_texts")
    return spark.sql("SELECT c.id, t.rel_path, c.chunk_index, c.content, c.start_line, c.end_line, c.section_level, c.function_name, c.kind FROM gleaner_texts t, LATERAL chunks(t.content, t.source_name, t.rel_path) c")


def embed_in_sql(spark, sf):
    register_embed(spark, MODELS["balanced"], name="embed")
    read(spark, sf, "benchmark").createOrReplaceTempView("gleaner_items")
    e = spark.sql("SELECT item_id, posexplode(embed(text)) AS (slot, x) FROM gleaner_items").filter("x <> 0")
    return e.select("item_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 5).alias("x"))


# -- chunks ------------------------------------------------------------------------------

LANGUAGES = ("go", "js", "ts", "rs")
_HEADS = {
    "go": ("func {0}(x int) {{", "func (r *T) {0}() {{", "type {0} struct {{", "type {0} = int"),
    "js": ("function {0}(x) {{", "async function {0}() {{", "const {0} = async (x) => {{", "class {0} extends B {{"),
    "ts": ("export abstract class {0} {{", "class {0} {{", "let {0} = function (x) {{", "interface {0} {{"),
    "rs": ("pub async fn {0}(x) {{", "fn {0}<T>(x) {{", "pub struct {0} {{", "impl {0} {{"),
}


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files of code in four languages, of lines that begin something and lines that only look so."""
    heads = F.array(*[F.array(*[F.lit(h.replace("{{", "{").replace("{0}", "@")) for h in _HEADS[x]]) for x in LANGUAGES])
    part = read(spark, sf, "part").select("p_partkey", F.expr("p_partkey % 4").cast("int").alias("l"), F.expr("p_partkey div 4 % 4").cast("int").alias("h"), F.expr("p_partkey % 97").alias("file"))
    line = F.concat(F.replace(F.get(F.get(heads, F.col("l")), F.col("h")), F.lit("@"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))), F.lit("\n  body\n}\n"))
    files = part.select("file", "l", F.struct("p_partkey", line.alias("line")).alias("x")).groupBy("file", "l").agg(F.array_sort(F.collect_list("x")).alias("x"))
    ext = F.get(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("l"))
    rel = F.concat(F.lit("f"), F.col("file").cast("string"), F.lit("."), ext)
    return files.select(F.lit("code").alias("source_name"), F.lit("/code").alias("source_path"), F.concat(F.lit("/code/"), rel).alias("abs_path"), rel.alias("rel_path"), ext.alias("extension"), F.array_join(F.transform("x", lambda y: y["line"]), "").alias("content"), F.lit(0).cast("long").alias("byte_size"), F.current_timestamp().alias("modified_at"))


def boundary_languages(spark, sf):
    docs = _sources(spark, sf)
    return docs.select("rel_path", F.explode(code_boundaries(F.col("content"), F.col("extension"))).alias("b")).select("rel_path", "b.offset", "b.name", "b.line")


def chunk_languages(spark, sf):
    return build_chunks(_sources(spark, sf), SMALL).select("id", "rel_path", "chunk_index", "content", "start_line", "end_line", "function_name", "kind", "language")


def fallback_record(spark, sf):
    """Blank texts are chunks without content."""
    docs = read(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" \n\t \n")).otherwise(F.col("text")))
    return build_chunks(table_documents(docs)).filter("content = ''").select("id", "rel_path", "chunk_index", "start_line", "end_line", "content")


# -- scans -------------------------------------------------------------------------------

_EXT = ("md", "txt", "MD", "exe", "min.js", "py")


def _put(path: str, raw: bytes) -> None:
    store, place = pafs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(raw)


def scan_files(spark, sf):
    """Directories as a scan reads them: kinds of files, ignore files, patterns, binary files, two sources and one that is off.

    Executors write a file for each document to the shared folder, then list and read them.
    """
    top = work_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, lang, text in zip(*[c.to_pylist() for c in b.columns]):
                folder = "node_modules" if i % 11 == 0 else "drafts" if i % 7 == 0 else "kept"
                raw = (text or "").encode()
                _put(f"{top}/{lang}/{folder}/doc_{i}.{_EXT[i % 6]}", raw + b"\0" if i % 13 == 0 else raw + b"\xff" if i % 17 == 0 else raw)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    read(spark, sf, "documents").select("doc_id", "lang", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    for lang in ("fr", "de"):
        _put(f"{top}/{lang}/.gitignore", b"# names that end in 1\n*1.txt\n!doc_*21.txt\nkept/*2.md\n")
    sources = [Source("english", f"{top}/en", exclude_patterns=["drafts/**", "*3.py"]), Source("other", top, exclude_patterns=["en/**"]), Source("off", top, enabled=False)]
    return scan_sources(spark, sources).select("source_name", "rel_path", "extension", "byte_size", t.content_hash(F.col("content")).alias("content_hash"))


# -- scalar functions ------------------------------------------------------------------------


def normalized_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha1(v.normalize_text(F.col("text")).cast("binary")).alias("digest"))


def pre_tokens(spark, sf):
    split = F.pandas_udf(lambda texts: texts.map(lambda x: pre_tokenize(plain(x))), "array<string>")
    return read(spark, sf, "benchmark").select("item_id", F.posexplode(split("text")).alias("at", "token"))


def hashed_token_ids(spark, sf):
    split = F.pandas_udf(lambda texts: texts.map(hashed_ids), "array<long>")
    return read(spark, sf, "benchmark").select("item_id", F.posexplode(split("text")).alias("at", "id"))


def hash_embed_query(spark, sf):
    """Query vectors of benchmark texts: the prefix of the model counts as words."""
    texts = read(spark, sf, "benchmark").select("item_id", v.hash_embedder(384)(F.concat(F.lit(QUERY_PREFIX), "text")).alias("e"))
    return texts.select("item_id", F.posexplode("e").alias("slot", "x")).filter("x <> 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 5).alias("x"))


def cosine_mixed_length(spark, sf):
    e = F.col("embedding")
    cut = F.slice(e, F.lit(1), (F.col("vec_id") % 65).cast("int"))
    zero = F.transform(e, lambda x: (x * 0).cast("float"))
    return read(spark, sf, "embeddings").select("vec_id", F.round(v.cosine(cut, F.reverse(e)).cast("double"), 5).alias("score"), v.cosine(zero, e).cast("double").alias("of_zero"))


def chunking_hashes(spark, sf):
    """Hashes of configurations made of parts' sizes."""
    size = F.col("p_size")
    sized = read(spark, sf, "part").select("p_partkey", (100 * size).alias("max_chars"), (10 * size).alias("overlap"), size.alias("min_chars"), (size % 2 == 0).alias("headings"))
    return sized.withColumn("hash", t.chunking_hash_of(*[F.col(c) for c in ("max_chars", "overlap", "min_chars", "headings")]))


def model_catalog(spark, sf):
    """What each document would take under a mode: windows of its model's length at four characters a token, and bytes of vectors."""
    rows = [(i, m.mode, m.name, m.dimension, m.max_tokens, m.size_mb, m.query_prefix != "", m.normalize) for i, m in enumerate(MODELS.values())]
    models = spark.createDataFrame(rows, "at int, mode string, name string, dimension int, max_tokens int, size_mb int, prefixed boolean, normalize boolean")
    joined = read(spark, sf, "documents").withColumn("at", (F.col("doc_id") % len(rows)).cast("int")).join(F.broadcast(models), "at").drop("at")  # a row for each mode
    windows = F.ceil(F.col("n_chars") / (4 * F.col("max_tokens"))).cast("long")
    return joined.select("doc_id", "mode", "name", "size_mb", "prefixed", "normalize", windows.alias("windows"), (4 * windows * F.col("dimension")).alias("vector_bytes"))


def model_variants(spark, sf):
    """The files that each document's mode tries on its machine, best first."""
    rows = [(i, k, m.mode, arch, place, file, priority) for i, m in enumerate(MODELS.values()) for k, arch in enumerate(("x86_64", "arm64")) for place, (_, file, priority) in enumerate(m.best_first(arch))]
    variants = spark.createDataFrame(rows, "at int, machine int, mode string, arch string, place int, file string, priority int")
    docs = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("at"), F.expr("doc_id div 4 % 2").cast("int").alias("machine"))
    return docs.join(F.broadcast(variants), ["at", "machine"]).drop("at", "machine")  # a row for each file of the catalogue


def engine_markdown(spark, sf):
    """Headings of markdown files as a bundle keeps them."""
    docs = _markdown(spark, sf).withColumn("content_hash", t.content_hash(F.col("content")))
    return engine(spark, docs, chunking=SMALL).bundle.chunks().select("id", "rel_path", "chunk_index", "title", "headings_json", "section_level")


def engine_index_choice(spark, sf):
    """A bundle of an earlier state, indexed once more with other settings, is rebuilt; with the same ones it is synced."""
    done, docs = _synced(spark, sf)
    synced = done.index(docs=docs)
    done.config.chunking = SMALL
    rebuilt = done.index(docs=docs)
    counts = spark.createDataFrame([(synced["new"], "new" in rebuilt, len(done.bundle.manifest()["segments"]))], "synced_new long, synced_twice boolean, segments int")
    return done.bundle.chunks().select("id", "rel_path", "chunk_index", "start_line", "end_line").crossJoin(F.broadcast(counts))  # one row


_WHOLE_WORDS = ("the", "river", "secret", "th", "of")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def wordpiece_ids(spark, sf):
    """Ids of documents under a vocabulary of letters and some words."""
    vocabulary = {w: 1000 + i for i, w in enumerate(_WHOLE_WORDS)} | {c: ord(c) for c in _LETTERS} | {f"##{c}": 500 + ord(c) for c in _LETTERS}
    piece = WordPiece.of(json.dumps({"model": {"type": "WordPiece", "vocab": vocabulary}}))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            for some in v.slices(x.fillna("").tolist()):
                yield pd.Series([piece.encode_array(t) for t in some])

    small_batches(spark)
    ids = read(spark, sf, "documents").select("doc_id", F.pandas_udf(encode, "array<long>")("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha1(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        engine_index, engine_state, engine_totals, engine_embeddings, engine_sync, engine_sync_counts, engine_sync_one_source, engine_search_semantic, engine_search_exact, engine_search_hybrid, engine_search_prefiltered,
        engine_markdown, engine_index_choice, exact_lines_indexed, exact_submatches_empty, vector_top_k_cells, chunks_in_sql, embed_in_sql, wordpiece_ids,
        exact_cap_of_fifty, rrf_synthetic, highlight, boundary_languages, chunk_languages, fallback_record, scan_files, normalized_texts, pre_tokens, hashed_token_ids, hash_embed_query, cosine_mixed_length, chunking_hashes, model_catalog, model_variants,
    )
}

# -- the same in SQL ------------------------------------------------------------------------

_NOTES = """docs AS (SELECT 'note' || item_id % 2 AS source_name, '/note' || item_id % 2 || '/doc_' || item_id || '.txt' AS file_path, 'doc_' || item_id || '.txt' AS rel_path, text AS content FROM benchmark)"""
_WHOLE = "SELECT rel_path, 0 AS s, length(content) AS e, '' AS name, 0 AS level FROM docs"
_NOTE_CHUNKS = f"WITH {_NOTES}, {chunk_sql(_WHOLE, Chunking(300, 50, 20))}"
_SLOTS = rf"""b AS (SELECT key, regexp_extract_all(lower(strip_accents(said)), '[\pL\pN_]+') AS w FROM said),
    t AS (SELECT key, unnest(w) AS token, 1.0::DOUBLE AS weight FROM b UNION ALL SELECT key, w[i] || '_' || w[i + 1], 0.5::DOUBLE FROM (SELECT *, unnest(range(1, len(w))) AS i FROM b)),
    h AS (SELECT key, weight, {FNV} AS h FROM t),
    p AS (SELECT key, h % 384 AS slot, CASE WHEN (h // 256) % 2 = 1 THEN weight ELSE -weight END AS x FROM h UNION ALL SELECT key, (h // 65536) % 384, 0.5 * weight FROM h),
    e AS (SELECT key, CAST(slot AS BIGINT) AS slot, sum(x) AS x FROM p GROUP BY key, slot HAVING sum(x) <> 0),
    unit AS (SELECT key, slot, (x / sqrt(sum(x * x) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS x FROM e)"""


def _near(question: str, where: str = "true") -> str:
    """Chunks of notes by cosine to a question."""
    return f"""said AS (SELECT id AS key, content AS said FROM chunks UNION ALL SELECT '?', '{QUERY_PREFIX}{question}'), {_SLOTS},
      score AS (SELECT c.id, c.rel_path, c.source_name, c.start_line, CAST(coalesce((SELECT sum(a.x * b.x) FROM unit a JOIN unit b ON a.slot = b.slot AND b.key = '?' WHERE a.key = c.id), 0) AS FLOAT) AS score FROM chunks c WHERE {where}),
      near AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM score)"""


_CODE = "part_lines AS (SELECT p_partkey, p_partkey % 97 AS file, ['" + "', '".join(LANGUAGES) + "'][p_partkey % 4 + 1] AS ext, replace([" + ", ".join("['" + "', '".join(h.replace("{{", "{").replace("{0}", "@") for h in _HEADS[x]) + "']" for x in LANGUAGES) + "][p_partkey % 4 + 1][p_partkey // 4 % 4 + 1], '@', 'f' || p_partkey) || chr(10) || '  body' || chr(10) || '}' || chr(10) AS line FROM part)"
_CODE_DOCS = f"{_CODE}, docs AS (SELECT 'code' AS source_name, 'f' || file || '.' || ext AS rel_path, ext, string_agg(line, '' ORDER BY p_partkey) AS content FROM part_lines GROUP BY file, ext)"
_PATTERNS = {
    "go": (r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"^type\s+(\w+)\s+(?:struct|interface|func|map|chan|\[)"),
    "js": (r"^(?:async\s+)?function\s+(\w+)\s*\(", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)", r"^class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{"),
    "ts": (r"^(?:async\s+)?function\s+(\w+)\s*\(", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)", r"^class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{", r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    "rs": (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(", r"^(?:pub\s+)?(?:struct|enum|trait|impl)\s+(?:<[^>]+>\s+)?(\w+)"),
}
_NAME = "CASE " + " ".join(f"WHEN ext = '{x}' AND regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for x, ps in _PATTERNS.items() for p in ps) + " END"
_CODE_MARKS = f"""WITH {_CODE_DOCS}, {LINES}, marks AS (SELECT * FROM (SELECT rel_path, CAST(pos AS INTEGER) AS "offset", CAST(n AS INTEGER) AS line, {_NAME} AS name, 0 AS level FROM trimmed JOIN (SELECT rel_path, ext FROM docs) USING (rel_path)) WHERE name IS NOT NULL)"""
_MARKED = """SELECT rel_path, "offset" AS s, coalesce(lead("offset") OVER (PARTITION BY rel_path ORDER BY "offset"), length(content)) AS e, name, level FROM marks JOIN docs USING (rel_path)"""
_LEAD = """ UNION ALL SELECT rel_path, 0, min("offset"), '', 0 FROM marks GROUP BY rel_path"""
_UNMARKED = " UNION ALL SELECT rel_path, 0, length(content), '', 0 FROM docs WHERE rel_path NOT IN (SELECT rel_path FROM marks)"
_PUNCT = r"!-/:-@\[-`{-~\pP"
_SCAN = rf"""f AS (SELECT doc_id AS i, lang, ['{"', '".join(_EXT)}'][doc_id % 6 + 1] AS ext, CASE WHEN doc_id % 11 = 0 THEN 'node_modules' WHEN doc_id % 7 = 0 THEN 'drafts' ELSE 'kept' END AS dir, coalesce(text, '') AS text FROM documents),
  g AS (SELECT *, dir || '/doc_' || i || '.' || ext AS rel FROM f WHERE dir <> 'node_modules' AND i % 13 <> 0 AND i % 17 <> 0 AND ext NOT IN ('exe', 'min.js')
        AND NOT (lang IN ('fr', 'de') AND (ext = 'txt' AND i % 10 = 1 AND i % 100 <> 21 OR ext = 'md' AND i % 10 = 2 AND dir = 'kept')))"""

_KEPT = "CASE WHEN doc_id % 10 = 1 THEN 'old words' || chr(10) || text ELSE text END AS content"

ORACLE_SQL = {
    "engine_index": f"{TEXT_CHUNKS} SELECT c.id, rel_path, chunk_index, c.content, start_line, end_line, 'text' AS kind, '' AS language, '' AS title, '' AS headings_json, CAST(strlen(d.content) AS BIGINT) AS byte_size, sha1(d.content) AS content_hash FROM chunks c JOIN docs d USING (rel_path)",
    "engine_state": f"{TEXT_CHUNKS} SELECT d.source_name, rel_path, sha1(d.content) AS content_hash, CAST(strlen(d.content) AS BIGINT) AS byte_size, count(c.id) AS chunks, arg_min(c.id, c.chunk_index) AS first FROM docs d LEFT JOIN chunks c USING (rel_path) GROUP BY ALL",
    "engine_totals": f"{TEXT_CHUNKS} SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks) AS embeddings, 1::BIGINT AS sources, (SELECT count(*) FROM docs WHERE source_name = 'src0') AS first_files, 'indexed' AS state",
    "engine_embeddings": f"{_NOTE_CHUNKS}, said AS (SELECT id AS key, content AS said FROM chunks), {_SLOTS} SELECT key AS chunk_id, slot, round(x, 5) AS x FROM unit",
    # a file of the same time as before counts as unchanged, whatever it holds
    "engine_sync": f"{TEXT_CHUNKS.replace('text AS content', _KEPT)} SELECT id, rel_path, chunk_index, start_line, end_line FROM chunks",
    "engine_sync_counts": "SELECT count(*) FILTER (doc_id % 10 = 0) AS new, count(*) FILTER (doc_id % 10 = 2) AS changed, count(*) FILTER (doc_id % 10 = 4) AS deleted, count(*) FILTER (doc_id % 10 NOT IN (0, 2)) AS unchanged FROM documents",
    "engine_sync_one_source": f"""WITH {DOCS} SELECT source_name, rel_path, CASE WHEN id % 10 = 1 OR (id % 10 = 2 AND source_name <> 'src0') THEN sha1('old words' || chr(10) || content) ELSE sha1(content) END AS content_hash FROM docs WHERE id % 10 <> 0 OR source_name = 'src0'
        UNION ALL SELECT source_name, 'gone_' || rel_path, sha1('gone') FROM docs WHERE id % 10 = 4 AND source_name <> 'src0'""",
    "engine_search_semantic": f"{_NOTE_CHUNKS}, {_near(QUESTION)} SELECT id AS chunk_id, '/' || source_name || '/' || rel_path AS file_path, round(score::DOUBLE, 4) AS score, rank AS semantic_rank, -1 AS exact_rank, source_name, 'text' AS kind, start_line FROM near WHERE rank < 15",
    "engine_search_exact": rf"""WITH {_NOTES}, found AS (SELECT file_path, source_name, CAST(n AS BIGINT) AS n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS x, row_number() OVER (PARTITION BY file_path ORDER BY n) AS k FROM (SELECT file_path, source_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs WHERE source_name = 'note1')
        WHERE regexp_matches(line, '(?i)(the|of) [a-z]')), r AS (SELECT *, CAST(row_number() OVER (ORDER BY file_path, n) - 1 AS INTEGER) AS rank FROM found WHERE k <= 50)
        SELECT '' AS chunk_id, file_path, CASE WHEN length(x) > 220 THEN left(x, 217) || '...' ELSE x END AS snippet, 1.0::DOUBLE AS score, -1 AS semantic_rank, rank AS exact_rank, source_name, 'text' AS kind, n AS start_line, n AS end_line FROM r WHERE rank < 12""",
    "engine_search_hybrid": f"""{_NOTE_CHUNKS}, {_near('the')},
        found AS (SELECT file_path, rel_path, source_name, CAST(n AS BIGINT) AS line_number, row_number() OVER (PARTITION BY file_path ORDER BY n) AS k FROM (SELECT file_path, rel_path, source_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs) WHERE contains(lower(line), 'the')),
        hits AS (SELECT *, CAST(row_number() OVER (ORDER BY file_path, line_number) - 1 AS INTEGER) AS rank FROM (SELECT * FROM found WHERE k <= 50 ORDER BY file_path, line_number LIMIT 200)), {MATCHED},
        parts AS (SELECT id, 1.0::DOUBLE / (61 + rank) AS part, rank AS s, -1 AS x FROM near WHERE rank < 200 UNION ALL SELECT m.chunk_id, 1.0::DOUBLE / (61 + h.rank), -1, h.rank FROM hits h JOIN matched m USING (file_path, line_number) WHERE m.chunk_id IS NOT NULL),
        fused AS (SELECT p.id, sum(part) AS score, max(s) AS semantic_rank, max(x) AS exact_rank, any_value(c.source_name) AS source_name, any_value(c.rel_path) AS rel_path FROM parts p JOIN chunks c ON c.id = p.id GROUP BY p.id),
        fetched AS (SELECT id AS chunk_id, '/' || source_name || '/' || rel_path AS file_path, score, semantic_rank, exact_rank, source_name, 'text' AS kind FROM fused
            UNION ALL SELECT 'exact:' || file_path || ':' || line_number, file_path, 1.0::DOUBLE / (61 + h.rank), -1, h.rank, h.source_name, '' FROM hits h JOIN matched m USING (file_path, line_number) WHERE m.chunk_id IS NULL ORDER BY score DESC, chunk_id LIMIT 200)
        SELECT chunk_id, file_path, round(score, 9) AS score, semantic_rank, exact_rank, source_name FROM fetched WHERE kind = 'text' ORDER BY fetched.score DESC, chunk_id LIMIT 20""",
    "engine_search_prefiltered": f"{_NOTE_CHUNKS}, {_near(QUESTION, chr(39).join(['c.source_name = ', 'note0', '']))} SELECT id AS chunk_id, round(score::DOUBLE, 4) AS score FROM near WHERE rank < 10",
    "exact_cap_of_fifty": """WITH p AS (SELECT '/parts/doc_' || p_partkey % 10 || '.txt' AS file_path, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS n FROM part)
        SELECT file_path, n AS line_number, CAST(row_number() OVER (ORDER BY file_path, n) - 1 AS INTEGER) AS rank FROM p WHERE n <= 50""",
    "rrf_synthetic": f"""{TEXT_CHUNKS}, kept AS (SELECT * FROM chunks JOIN (SELECT rel_path FROM docs WHERE id % 2 = 0) USING (rel_path)), {exact_sql()}, {MATCHED.replace('JOIN chunks', 'JOIN kept')}
        SELECT chunk_id, round(sum(1.0::DOUBLE / (61 + h.rank)), 9) AS score, -1 AS semantic_rank, max(h.rank) AS exact_rank, any_value(h.source_name) AS source_name FROM hits h JOIN matched m USING (file_path, line_number) WHERE chunk_id IS NOT NULL GROUP BY chunk_id
        UNION ALL SELECT 'exact:' || file_path || ':' || line_number, round(1.0::DOUBLE / (61 + h.rank), 9), -1, h.rank, h.source_name FROM hits h JOIN matched m USING (file_path, line_number) WHERE chunk_id IS NULL""",
    "highlight": f"WITH {DOCS}, {exact_sql()} SELECT file_path, line_number, regexp_replace(line_text, '(?i)((?:{TERM})+)', chr(27) || '[1;33m' || '\\1' || chr(27) || '[0m', 'g') AS marked FROM hits",
    "boundary_languages": f'{_CODE_MARKS} SELECT rel_path, "offset", name, line FROM marks',
    "chunk_languages": f"{_CODE_MARKS}, {chunk_sql(_MARKED + _LEAD + _UNMARKED, SMALL)} SELECT id, rel_path, chunk_index, content, start_line, end_line, name AS function_name, 'code' AS kind, CASE split_part(rel_path, '.', 2) WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE 'rust' END AS language FROM chunks",
    "fallback_record": r"SELECT sha1(source || '|doc_' || doc_id || '.txt|0|' || sha1(' ' || chr(10) || chr(9) || ' ' || chr(10))) AS id, 'doc_' || doc_id || '.txt' AS rel_path, 0::BIGINT AS chunk_index, 1::BIGINT AS start_line, 3::BIGINT AS end_line, '' AS content FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT sha1(source || '|doc_' || doc_id || '.txt|0|' || sha1(text)), 'doc_' || doc_id || '.txt', 0, 1, 1 + length(text) - length(replace(text, chr(10), '')), '' FROM documents WHERE doc_id % 5 <> 0 AND length(text) > 0 AND regexp_full_match(text, '\s*')",
    "scan_files": rf"""WITH {_SCAN}
        SELECT 'english' AS source_name, rel AS rel_path, lower(ext) AS extension, CAST(strlen(text) AS BIGINT) AS byte_size, sha1(text) AS content_hash FROM g WHERE lang = 'en' AND dir <> 'drafts' AND NOT (ext = 'py' AND i % 10 = 3)
        UNION ALL SELECT 'other', lang || '/' || rel, lower(ext), CAST(strlen(text) AS BIGINT), sha1(text) FROM g WHERE lang <> 'en'""",
    "normalized_texts": r"SELECT doc_id, sha1(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS digest FROM documents",
    "pre_tokens": rf"SELECT item_id, CAST(i - 1 AS INTEGER) AS at, w[i] AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[{_PUNCT}]|[^\s{_PUNCT}]+') AS w FROM benchmark))",
    "hashed_token_ids": r"SELECT item_id, CAST(i - 1 AS INTEGER) AS at, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(w[i], ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619::HUGEINT) % 18446744073709551616::HUGEINT) % 30000 + 1000 AS BIGINT) AS id FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\s]+') AS w FROM benchmark))",
    "hash_embed_query": f"WITH said AS (SELECT item_id AS key, '{QUERY_PREFIX}' || text AS said FROM benchmark), {_SLOTS} SELECT key AS item_id, slot, round(x, 5) AS x FROM unit",
    "cosine_mixed_length": "SELECT vec_id, CASE WHEN n = 0 THEN 0 ELSE round(list_cosine_similarity(CAST(embedding[1:n] AS DOUBLE[]), CAST(list_reverse(embedding)[1:n] AS DOUBLE[]))::FLOAT::DOUBLE, 5) END AS score, 0.0::DOUBLE AS of_zero FROM (SELECT vec_id, embedding, vec_id % 65 AS n FROM embeddings)",
    "chunking_hashes": """SELECT *, sha1(max_chars || '|' || overlap || '|' || min_chars || '|' || CAST(headings AS VARCHAR)) AS hash
        FROM (SELECT p_partkey, 100 * p_size AS max_chars, 10 * p_size AS overlap, p_size AS min_chars, p_size % 2 = 0 AS headings FROM part)""",
    "model_catalog": """WITH m(nth, mode, name, dimension, max_tokens, size_mb, prefixed, normalize) AS (VALUES (0, 'light', 'all-MiniLM-L6-v2', 384, 256, 23, false, true), (1, 'balanced', 'bge-small-en-v1.5', 384, 512, 33, true, true),
        (2, 'quality', 'bge-base-en-v1.5', 768, 512, 218, true, true), (3, 'nomic', 'nomic-embed-text-v1', 768, 2048, 550, false, true))
        SELECT doc_id, mode, name, size_mb, prefixed, normalize, CAST(ceil(n_chars / (4.0 * max_tokens)) AS BIGINT) AS windows, CAST(4 * dimension * ceil(n_chars / (4.0 * max_tokens)) AS BIGINT) AS vector_bytes FROM documents JOIN m ON m.nth = doc_id % 4""",
    "model_variants": """WITH x(nth, mode, file, priority, arm) AS (VALUES (0, 'light', 'onnx/model_qint8_arm64.onnx', 100, true), (0, 'light', 'onnx/model_O4.onnx', 90, false), (0, 'light', 'onnx/model_O3.onnx', 80, false), (0, 'light', 'onnx/model_O2.onnx', 70, false), (0, 'light', 'onnx/model.onnx', 10, false),
        (1, 'balanced', 'model_qint8.onnx', 100, false), (1, 'balanced', 'onnx/model.onnx', 10, false), (2, 'quality', 'model_optimized.onnx', 100, false), (2, 'quality', 'onnx/model.onnx', 10, false), (3, 'nomic', 'onnx/model.onnx', 10, false)),
        v AS (SELECT nth, machine, mode, arch, CAST(row_number() OVER (PARTITION BY mode, arch ORDER BY priority DESC) - 1 AS INTEGER) AS place, file, priority FROM x, (VALUES ('x86_64', 0), ('arm64', 1)) a(arch, machine) WHERE arch = 'arm64' OR NOT arm)
        SELECT doc_id, mode, arch, place, file, priority FROM documents JOIN v ON v.nth = doc_id % 4 AND v.machine = doc_id // 4 % 2""",
    "engine_markdown": f"""WITH {MARKDOWN}, {LINES}, {HEADS}, {chunk_sql(_MARKED, SMALL)}, h AS (SELECT rel_path, arg_min(name, "offset") AS first, '["' || string_agg(name, '","' ORDER BY "offset") || '"]' AS headings_json FROM marks GROUP BY rel_path)
        SELECT id, rel_path, chunk_index, CASE WHEN name <> '' THEN name ELSE first END AS title, headings_json, CAST(level AS BIGINT) AS section_level FROM chunks JOIN h USING (rel_path)""",
    "engine_index_choice": f"WITH {DOCS}, {chunk_sql(_WHOLE, SMALL)} SELECT id, rel_path, chunk_index, start_line, end_line, (SELECT count(*) FILTER (doc_id % 10 = 0) FROM documents) AS synced_new, false AS synced_twice, 1 AS segments FROM chunks",
    "exact_lines_indexed": f"WITH {DOCS}, {exact_sql()} SELECT file_path, source_name, line_number, line_text, rank FROM hits",
    "exact_submatches_empty": f"""WITH {DOCS}, {exact_sql().replace(f'(?i){TERM}', '(?i)e*')},
        g AS (SELECT file_path, line_number, regexp_extract_all(line, '(?i)e+') AS m, string_split_regex(line, '(?i)e+') AS gaps FROM hits),
        x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM g)
        SELECT file_path, line_number, CAST(i - 1 AS INTEGER) AS n, CAST(strlen(array_to_string(gaps[1:i], '')) + strlen(array_to_string(m[1:i - 1], '')) AS INTEGER) AS start,
               CAST(strlen(array_to_string(gaps[1:i], '')) + strlen(array_to_string(m[1:i], '')) AS INTEGER) AS "end" FROM x""",
    "vector_top_k_cells": f"WITH {HITS} SELECT vec_id AS chunk_id, round(score::DOUBLE, 5) AS score, rank FROM near WHERE rank < 50",
    "chunks_in_sql": f"""SELECT * FROM (WITH {MARKDOWN}, {LINES}, {HEADS}, {chunk_sql(_MARKED, SMALL)} SELECT id, rel_path, chunk_index, content, start_line, end_line, CAST(level AS BIGINT) AS section_level, '' AS function_name, 'markdown' AS kind FROM chunks)
        UNION ALL SELECT * FROM (WITH {CODE}, {LINES}, {BOUNDS}, {chunk_sql(_MARKED + _LEAD, SMALL)} SELECT id, rel_path, chunk_index, content, start_line, end_line, 0::BIGINT AS section_level, name AS function_name, 'code' AS kind FROM chunks)""",
    "embed_in_sql": f"WITH said AS (SELECT item_id AS key, text AS said FROM benchmark), {_SLOTS} SELECT key AS item_id, slot, round(x, 5) AS x FROM unit",
    # a word begins with the longest word of the vocabulary, or a letter; the rest are letters
    "wordpiece_ids": rf"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[{_PUNCT}]|[^\s{_PUNCT}]+'), lambda x: CASE
            WHEN NOT regexp_matches(x, '^[a-z]+$') OR strlen(x) > 100 THEN ['100']
            ELSE list_concat([CASE regexp_extract(x, '^(secret|river|the|th|of|[a-z])', 1) WHEN 'the' THEN '1000' WHEN 'river' THEN '1001' WHEN 'secret' THEN '1002' WHEN 'th' THEN '1003' WHEN 'of' THEN '1004' ELSE CAST(ascii(x) AS VARCHAR) END],
                 list_transform(regexp_extract_all(regexp_replace(x, '^(secret|river|the|th|of|[a-z])', ''), '[a-z]'), lambda c: CAST(500 + ascii(c) AS VARCHAR))) END) AS ids FROM documents),
        f AS (SELECT doc_id, list_concat(['101'], flatten(ids), ['102']) AS ids FROM w) SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, sha1(array_to_string(ids, ',')) AS digest FROM f""",
}
