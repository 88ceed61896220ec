"""Registered queries for the retrieval operators, each over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..functions.arrays import let
from ..operators import maintenance as m
from ..operators import search as s
from ..operators.chunking import Chunking, build_chunks, code_boundaries, headings
from ..sources.scan import table_documents
from ..sources.shared import work_dir

SMALL = Chunking(1000, 100, 10)
TERM, LIMIT = "there", 500
EXTENSIONS = ("md", "markdown", "go", "rs", "tsx", "py", "java", "h", "zsh", "yml", "txt", "canvas", "exe", "")
#: name and path; two are nested, one only looks as if
SOURCES = (("all", "/"), ("zero", "/src0"), ("zero deep", "/src0/en"), ("one", "/src1"), ("eleven", "/src11"))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table_documents(read(spark, sf, "documents"))


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: F.concat(F.lit("## Turn "), r["turn"].cast("string"), F.lit(" "), r["role"], F.lit("\n"), F.coalesce(r["text"], F.lit("")), F.lit("\n"))), "")
    return table_documents(turns.select("conv_id", F.lit("talk").alias("source"), F.concat(F.lit("lost preamble\n"), body).alias("text")), key="conv_id", extension="md")


def _code(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: F.concat(F.lit("def fn_"), r["p_partkey"].cast("string"), F.lit("(x):\n    return '"), r["p_name"], F.lit("'\n"))), "")
    return table_documents(files.select(F.col("p_brand").alias("brand"), F.lit("parts").alias("source"), F.concat(F.lit("import os\n\n"), body).alias("text")), key="brand", extension="py")


def _chunked(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    return build_chunks(docs, config).select("id", "rel_path", "chunk_index", "content", "start_line", "end_line", "title", "section_level", "function_name", "kind")


def chunk_windows(spark, sf):
    return _chunked(documents(spark, sf)).drop("title", "section_level", "function_name", "kind")


def chunk_headings(spark, sf):
    return _chunked(_markdown(spark, sf), SMALL).drop("function_name")


def chunk_code(spark, sf):
    return _chunked(_code(spark, sf), SMALL).drop("title", "section_level")


def heading_marks(spark, sf):
    return _markdown(spark, sf).select("rel_path", F.explode(headings(F.col("content"))).alias("h")).select("rel_path", "h.offset", "h.name", "h.level")


def boundary_marks(spark, sf):
    return _code(spark, sf).select("rel_path", F.explode(code_boundaries(F.col("content"), F.col("extension"))).alias("b")).select("rel_path", "b.offset", "b.name")


def content_hashes(spark, sf):
    return documents(spark, sf).select("rel_path", t.content_hash(F.col("content")).alias("content_hash"), "byte_size")


def _extended(spark, sf):
    ext = F.get(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return read(spark, sf, "documents").select("doc_id", ext.alias("ext"), F.concat(F.lit("/a.b/f"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), F.upper(ext)))).alias("path"))


def classify_kind(spark, sf):
    return _extended(spark, sf).select("doc_id", t.classify_kind(F.col("ext")).alias("kind"), t.kind_of_path(F.col("path")).alias("path_kind"), t.normalize_ext(F.col("path")).alias("ext"))


def detect_language(spark, sf):
    return _extended(spark, sf).select("doc_id", t.detect_language(F.col("ext")).alias("language"), t.language_of_path(F.col("path")).alias("path_language"))


def snippets(spark, sf):
    return read(spark, sf, "documents").select("doc_id", t.snippet(F.col("text")).alias("snippet"), t.clean_snippet(F.col("text")).alias("cleaned"))


def exact_lines(spark, sf):
    return s.exact_lines(documents(spark, sf), TERM, LIMIT).drop("submatches", "rel_path", "lead")


def exact_cap_per_file(spark, sf):
    return s.exact_lines(documents(spark, sf), TERM, LIMIT, 2).select("file_path", "line_number", "rank")


def exact_submatches(spark, sf):
    found = s.exact_lines(documents(spark, sf), TERM, LIMIT).select("file_path", "line_number", F.posexplode("submatches").alias("n", "x"))
    return found.select("file_path", "line_number", "n", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def longest_prefix_source(spark, sf):
    files = read(spark, sf, "documents").select(F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string")).alias("file_path"))
    return s.longest_prefix_source(files, spark.createDataFrame(SOURCES, "name string, path string"))


def _lines(spark, sf):
    return s.exact_lines(documents(spark, sf), TERM, LIMIT)


def _chunks(spark, sf):
    """Chunks of all documents as a bundle has them: built and written once, then read."""
    path = f"{work_dir(spark)}/chunks"
    build_chunks(documents(spark, sf)).drop("created_at").write.parquet(path)
    return spark.read.parquet(path)


def interval_join_chunks(spark, sf):
    return s.match_to_chunk(_lines(spark, sf), _chunks(spark, sf)).select("file_path", "line_number", "chunk_id")


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _query(spark, sf) -> list[float]:
    return read(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


def vector_cosine(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in _query(spark, sf)])
    half = F.slice("vector", F.lit(1), F.lit(32))
    return _vectors(spark, sf).select("chunk_id", F.round(v.cosine(F.col("vector"), q).cast("double"), 5).alias("score"), F.round(v.cosine(half, q).cast("double"), 5).alias("half_score"))


def vector_top_k(spark, sf):
    return s.vector_top_k(_vectors(spark, sf), _query(spark, sf), 50).select("chunk_id", F.round(F.col("score").cast("double"), 5).alias("score"), "rank")


def l2_normalize(spark, sf):
    long = F.transform("vector", lambda x: (x * 3).cast("float"))
    return _vectors(spark, sf).select("chunk_id", F.posexplode(v.l2_normalize(long)).alias("slot", "x")).select("chunk_id", "slot", F.round(F.col("x").cast("double"), 5).alias("x"))


def tokenize(spark, sf):
    # behind a generator, or the filter would have every text tokenized twice
    of_text = let(v.tokenize(F.col("text")), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_min(t).alias("least"), F.array_max(t).alias("greatest")))
    return read(spark, sf, "documents").select("doc_id", F.explode_outer(F.array(of_text)).alias("x")).select("doc_id", "x.*").filter("n_tokens > 0")


def hash_embed_tokens(spark, sf):
    tokens = read(spark, sf, "benchmark").select(F.explode(v.tokenize(F.col("text"))).alias("token")).distinct()
    first, sign, second = v.token_slots(F.col("token"), 384)
    return tokens.select("token", first.cast("long").alias("slot"), sign.alias("sign"), second.cast("long").alias("second_slot"))


def hash_embed(spark, sf):
    texts = read(spark, sf, "benchmark").select("item_id", v.hash_embedder(384, False)(F.col("text")).alias("e"))
    return texts.select("item_id", F.posexplode("e").alias("slot", "x")).filter("x <> 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.col("x").cast("double").alias("x"))


def _semantic(spark, sf, chunks):
    """Hits whose ids are those of the first windows of the documents of the nearest vectors."""
    hits = s.vector_top_k(_vectors(spark, sf), _query(spark, sf), 100)
    first = chunks.groupBy("rel_path").agg(F.min_by("id", "chunk_index").alias("id"))
    return hits.join(first, F.concat(F.lit("doc_"), F.col("chunk_id").cast("string"), F.lit(".txt")) == F.col("rel_path")).select(F.col("id").alias("chunk_id"), "rank")


def _fused(spark, sf):
    chunks = _chunks(spark, sf)
    return s.rrf_fuse(_semantic(spark, sf, chunks), _lines(spark, sf), chunks)


def rrf_fuse(spark, sf):
    fused = _fused(spark, sf)
    return fused.select("chunk_id", F.round("score", 9).alias("score"), "semantic_rank", "exact_rank", "source_name", "start_line")


def search_hybrid(spark, sf):
    fused = _fused(spark, sf)
    fetched = s.filtered(fused, source="src0").orderBy(F.desc("score"), "chunk_id").limit(100)
    return s.filtered(fetched, kind="TEXT", directory="src0/").orderBy(F.desc("score"), "chunk_id").limit(10).select("chunk_id", F.round("score", 9).alias("score"))


def search_exact(spark, sf):
    lines = s.exact_lines(documents(spark, sf).filter("source_name = 'src0'"), TERM, 50)
    return lines.withColumns({"kind": t.kind_of_path(F.col("file_path")), "snippet": t.snippet(F.col("line_text"))}).filter("kind = 'text'").orderBy("rank").limit(10).select("file_path", "line_number", "snippet", "kind")


def search_semantic(spark, sf):
    hits = s.vector_top_k(_vectors(spark, sf), _query(spark, sf), s.semantic_fetch(10))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.col("lang").alias("language"), F.lit("text").alias("kind"), F.lit("").alias("file_path"))
    found = F.broadcast(hits).join(docs, "chunk_id")
    return s.filtered(found, language="FR, en", kind="Text").orderBy("rank").limit(10).select("chunk_id", "rank", "language")


def filters(spark, sf):
    docs = documents(spark, sf).join(read(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("lang").alias("language")), "rel_path").withColumnRenamed("abs_path", "file_path").withColumn("kind", F.lit("text"))
    named = {"language": {"language": "EN, de"}, "kind": {"kind": "TEXT"}, "dir": {"directory": "src1/"}, "source": {"source": "src2"}}
    out = None
    for name, how in named.items():
        part = s.filtered(docs, **how).select(F.lit(name).alias("filter"), "file_path")
        out = part if out is None else out.unionByName(part)
    return out


def before(spark, sf, *more):
    """An earlier state: some documents not there yet, some with another text, some of those with another time, some since gone; more: columns of documents that go with it, null for those gone."""
    old = documents(spark, sf).withColumn("content_hash", t.content_hash(F.col("content"))).withColumn("id", F.regexp_extract("rel_path", r"(\d+)", 1).cast("long"))
    d = F.col("id") % 10
    kept = old.filter(d != 0).withColumns({"content_hash": F.when(d.isin(1, 2), F.lit("x")).otherwise(F.col("content_hash")), "modified_at": F.when(d.isin(2, 3), F.col("modified_at") - F.expr("interval 1 day")).otherwise(F.col("modified_at"))})
    gone = old.filter(d == 4).withColumns({"rel_path": F.concat(F.lit("gone_"), "rel_path")} | {c: F.lit(None).cast(old.schema[c].dataType) for c in more})
    return kept.unionByName(gone).withColumn("chunk_ids", F.array(F.concat(F.lit("c_"), "rel_path"), F.concat(F.lit("d_"), "rel_path"))).select(*m.KEY, "content_hash", "modified_at", "byte_size", "chunk_ids", *more)


def now(spark, sf):
    return documents(spark, sf).withColumn("content_hash", t.content_hash(F.col("content")))


def sync_diff(spark, sf):
    return m.state_diff(now(spark, sf), before(spark, sf))


def sync_remove(spark, sf):
    state = before(spark, sf)
    diff = m.state_diff(now(spark, sf), state)
    rows = state.select("rel_path", F.explode("chunk_ids").alias("id"))
    return m.remove_chunks(rows, m.expand_state_ids(state, diff.filter(F.col("status").isin("changed", "deleted")))).select("rel_path", "id")


def sync_merge(spark, sf):
    old = before(spark, sf).select("rel_path", F.explode("chunk_ids").alias("id"), F.lit("old").alias("made"))
    new = m.files_to_process(now(spark, sf), m.state_diff(now(spark, sf), before(spark, sf))).select("rel_path", F.concat(F.lit("c_"), "rel_path").alias("id"), F.lit("new").alias("made"))
    return m.merge_rows(old, new).select("rel_path", "id", "made")


def sync_state(spark, sf):
    state, docs = before(spark, sf), now(spark, sf)
    diff = m.state_diff(docs, state)
    chunks = m.files_to_process(docs, diff).select(*m.KEY, F.lit(0).alias("chunk_index"), F.concat(F.lit("n_"), "rel_path").alias("id"))
    fresh = m.records_by_file(m.files_to_process(docs, diff), chunks)
    return m.update_state(state, diff, fresh).select(*m.KEY, "content_hash", F.date_format("modified_at", "yyyy-MM-dd").alias("day"), F.concat_ws(",", "chunk_ids").alias("chunk_ids"))


def status_counts(spark, sf):
    sources = spark.createDataFrame([("src0", True), ("src1", False), ("none", True)], "name string, enabled boolean")
    return m.count_files_per_source(before(spark, sf), sources)


QUERIES = {
    f.__name__: f
    for f in (
        chunk_windows, chunk_headings, chunk_code, heading_marks, boundary_marks, content_hashes, classify_kind, detect_language, snippets, exact_lines,
        exact_cap_per_file, exact_submatches, longest_prefix_source, interval_join_chunks, vector_cosine, vector_top_k, l2_normalize, tokenize, hash_embed_tokens, hash_embed,
        rrf_fuse, search_hybrid, search_exact, search_semantic, filters, sync_diff, sync_remove, sync_merge, sync_state, status_counts,
    )
}

# -- the same in SQL ------------------------------------------------------

DOCS = """docs AS (SELECT source AS source_name, '/' || source || '/doc_' || doc_id || '.txt' AS file_path, 'doc_' || doc_id || '.txt' AS rel_path,
    text AS content, doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' AS modified_at FROM documents)"""
MARKDOWN = r"""docs AS (SELECT 'talk' AS source_name, 'doc_' || conv_id || '.md' AS rel_path,
    'lost preamble' || chr(10) || string_agg('## Turn ' || turn || ' ' || role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id)"""
CODE = r"""docs AS (SELECT 'parts' AS source_name, 'doc_' || p_brand || '.py' AS rel_path,
    'import os' || chr(10) || chr(10) || string_agg('def fn_' || p_partkey || '(x):' || chr(10) || '    return ''' || p_name || '''' || chr(10), '' ORDER BY p_partkey) AS content FROM part GROUP BY p_brand)"""
LINES = """lines AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY rel_path ORDER BY n) - length(line) - 1 AS pos
    FROM (SELECT rel_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs)),
  trimmed AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines)""".replace("\\\\", "\\")
HEADS = r"""marks AS (SELECT rel_path, CAST(pos AS INTEGER) AS "offset", regexp_replace(regexp_replace(t, '^#+', ''), '^\s+', '') AS name, CAST(length(regexp_extract(t, '^#+')) AS INTEGER) AS level
    FROM trimmed WHERE regexp_matches(t, '^#{1,6}[^#]') AND regexp_replace(regexp_replace(t, '^#+', ''), '\s+', '', 'g') <> '')"""
BOUNDS = r"""marks AS (SELECT rel_path, CAST(pos AS INTEGER) AS "offset", regexp_extract(t, '^(?:async\s+)?def\s+(\w+)\s*\(', 1) AS name, 0 AS level
    FROM trimmed WHERE regexp_matches(t, '^(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*:'))"""


def chunk_sql(sections: str, c: Chunking) -> str:
    """Windows of ``sections`` (rel_path, s, e, name, level), then trimming, dropping, lines and ids."""
    step = c.max_chars - c.overlap_chars
    return rf"""sections AS ({sections}),
  cuts AS (SELECT *, unnest(range(0, CASE WHEN e - s <= {c.max_chars} THEN 1 ELSE 1 + CAST(ceil((e - s - {c.max_chars}) / {step}.0) AS BIGINT) END)) AS w FROM sections WHERE e > s),
  windows AS (SELECT rel_path, s + w * {step} AS ws, least(s + w * {step} + {c.max_chars}, e) AS we, CASE WHEN w = 0 THEN name ELSE '' END AS name, CASE WHEN w = 0 THEN level ELSE 0 END AS level,
    row_number() OVER (PARTITION BY rel_path ORDER BY s, w) - 1 AS i, count(*) OVER (PARTITION BY rel_path) AS n FROM cuts),
  bodies AS (SELECT *, regexp_replace(substring(content, CAST(ws + 1 AS BIGINT), CAST(we - ws AS BIGINT)), '^\s+|\s+$', '', 'g') AS body FROM windows JOIN docs USING (rel_path)),
  chunks AS (SELECT sha1(source_name || '|' || rel_path || '|' || i || '|' || sha1(content)) AS id, source_name, rel_path, CAST(i AS BIGINT) AS chunk_index, body AS content, name, level,
    1 + length(left(content, CAST(ws AS BIGINT))) - length(replace(left(content, CAST(ws AS BIGINT)), chr(10), '')) AS start_line, 1 + length(left(content, CAST(we AS BIGINT))) - length(replace(left(content, CAST(we AS BIGINT)), chr(10), '')) AS end_line
    FROM bodies WHERE body <> '' AND (length(body) >= {c.min_chars} OR i = n - 1 OR n <= 1))"""


_WHOLE = "SELECT rel_path, 0 AS s, length(content) AS e, '' AS name, 0 AS level FROM docs"
_MARKED = """SELECT rel_path, "offset" AS s, coalesce(lead("offset") OVER (PARTITION BY rel_path ORDER BY "offset"), length(content)) AS e, name, level FROM marks JOIN docs USING (rel_path)"""
_LEAD = """ UNION ALL SELECT rel_path, 0, min("offset"), '', 0 FROM marks GROUP BY rel_path"""
TEXT_CHUNKS = f"WITH {DOCS}, {chunk_sql(_WHOLE, Chunking())}"
EXACT = f"""found AS (SELECT file_path, rel_path, source_name, CAST(n AS BIGINT) AS line_number, line FROM (SELECT file_path, rel_path, source_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs)
    WHERE regexp_matches(line, '(?i){TERM}')),
  capped AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_number) AS k FROM found)"""


def exact_sql(cap: int = s.LINES_PER_FILE, limit: int = LIMIT, where: str = "true") -> str:
    return f"""{EXACT}, hits AS (SELECT file_path, rel_path, source_name, line_number, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line_text, CAST(row_number() OVER (ORDER BY file_path, line_number) - 1 AS INTEGER) AS rank
    FROM (SELECT * FROM capped WHERE k <= {cap} AND {where} ORDER BY file_path, line_number LIMIT {limit}))"""


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
HITS = f"""near AS (SELECT e.vec_id, CAST(row_number() OVER (ORDER BY CAST({_COSINE} AS FLOAT) DESC, e.vec_id) - 1 AS INTEGER) AS rank, CAST({_COSINE} AS FLOAT) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""
MATCHED = """matched AS (SELECT h.file_path, h.line_number, arg_min(c.id, {'w': c.end_line - c.start_line, 's': c.start_line, 'i': c.chunk_index, 'id': c.id}) AS chunk_id
    FROM hits h LEFT JOIN chunks c ON c.rel_path = h.rel_path AND c.source_name = h.source_name AND h.line_number BETWEEN c.start_line AND c.end_line GROUP BY ALL)"""
FUSED = f"""{HITS}, sem AS (SELECT c.id AS chunk_id, n.rank FROM near n JOIN (SELECT rel_path, arg_min(id, chunk_index) AS id FROM chunks GROUP BY rel_path) c ON c.rel_path = 'doc_' || n.vec_id || '.txt' WHERE n.rank < 100),
  parts AS (SELECT chunk_id AS id, 1.0::DOUBLE / (61 + rank) AS part, rank AS s, -1 AS x FROM sem
    UNION ALL SELECT m.chunk_id, 1.0::DOUBLE / (61 + h.rank), -1, h.rank FROM hits h JOIN matched m USING (file_path, line_number) WHERE m.chunk_id IS NOT NULL),
  fused AS (SELECT id AS chunk_id, sum(part) AS score, max(p.s) AS semantic_rank, max(p.x) AS exact_rank, any_value(c.source_name) AS source_name, any_value(c.start_line) AS start_line FROM parts p JOIN chunks c USING (id) GROUP BY id
    UNION ALL SELECT 'exact:' || file_path || ':' || line_number, 1.0::DOUBLE / (61 + h.rank), -1, h.rank, h.source_name, line_number FROM hits h JOIN matched m USING (file_path, line_number) WHERE m.chunk_id IS NULL)"""
STATE = f"""WITH {DOCS}, now AS (SELECT source_name, rel_path, sha1(content) AS content_hash, modified_at FROM docs),
  state AS (SELECT source_name, rel_path, CASE WHEN id % 10 IN (1, 2) THEN 'x' ELSE sha1(content) END AS content_hash, CASE WHEN id % 10 IN (2, 3) THEN modified_at - INTERVAL 1 DAY ELSE modified_at END AS modified_at FROM docs WHERE id % 10 <> 0
    UNION ALL SELECT source_name, 'gone_' || rel_path, sha1(content), modified_at FROM docs WHERE id % 10 = 4),
  diff AS (SELECT source_name, rel_path, CASE WHEN s.content_hash IS NULL THEN 'new' WHEN n.content_hash IS NULL THEN 'deleted' WHEN s.modified_at = n.modified_at OR s.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM now n FULL JOIN state s USING (source_name, rel_path))"""
FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(token) + 1), lambda i: ascii(chr(0)) + ('0x' || substring(hex(encode(token)), 2 * i - 1, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_KIND = "CASE {0} " + " ".join(f"WHEN '{e}' THEN '{k}'" for k, es in t.KINDS.items() for e in es) + " ELSE 'unknown' END"
_LANG = "CASE {0} " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in t.LANGUAGES.items()) + "{1} ELSE '' END"
_EXT = f"WITH x AS (SELECT doc_id, [{', '.join(repr(e) for e in EXTENSIONS)}][doc_id % {len(EXTENSIONS)} + 1] AS ext FROM documents), y AS (SELECT *, CASE WHEN ext = '' THEN 'b/f' || doc_id ELSE ext END AS path_ext FROM x)"

ORACLE_SQL = {
    "chunk_windows": f"{TEXT_CHUNKS} SELECT id, rel_path, chunk_index, content, start_line, end_line FROM chunks",
    "chunk_headings": f"WITH {MARKDOWN}, {LINES}, {HEADS}, {chunk_sql(_MARKED, SMALL)}, firsts AS (SELECT rel_path, arg_min(name, \"offset\") AS first FROM marks GROUP BY rel_path) SELECT id, rel_path, chunk_index, content, start_line, end_line, CASE WHEN name <> '' THEN name ELSE first END AS title, CAST(level AS BIGINT) AS section_level, 'markdown' AS kind FROM chunks JOIN firsts USING (rel_path)",
    "chunk_code": f"WITH {CODE}, {LINES}, {BOUNDS}, {chunk_sql(_MARKED + _LEAD, SMALL)} SELECT id, rel_path, chunk_index, content, start_line, end_line, name AS function_name, 'code' AS kind FROM chunks",
    "heading_marks": f'WITH {MARKDOWN}, {LINES}, {HEADS} SELECT rel_path, "offset", name, level FROM marks',
    "boundary_marks": f'WITH {CODE}, {LINES}, {BOUNDS} SELECT rel_path, "offset", name FROM marks',
    "content_hashes": f"WITH {DOCS} SELECT rel_path, sha1(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS byte_size FROM docs",
    "classify_kind": f"{_EXT} SELECT doc_id, {_KIND.format('ext')} AS kind, {_KIND.format('path_ext')} AS path_kind, ext FROM y",
    "detect_language": f"{_EXT} SELECT doc_id, {_LANG.format('ext', '')} AS language, {_LANG.format('path_ext', chr(32) + 'WHEN ' + repr('markdown') + ' THEN ' + repr('markdown'))} AS path_language FROM y",
    "snippets": r"SELECT doc_id, CASE WHEN length(text) > 220 THEN left(text, 217) || '...' ELSE text END AS snippet, CASE WHEN length(c) > 180 THEN left(c, 177) || '...' ELSE c END AS cleaned FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)",
    "exact_lines": f"WITH {DOCS}, {exact_sql()} SELECT file_path, source_name, line_number, line_text, rank FROM hits",
    "exact_cap_per_file": f"WITH {DOCS}, {exact_sql(2)} SELECT file_path, line_number, rank FROM hits",
    "exact_submatches": f"""WITH {DOCS}, {exact_sql()}, pieces AS (SELECT file_path, line_number, string_split(lower(line), '{TERM}') AS p FROM hits)
        SELECT file_path, line_number, CAST(n AS INTEGER) AS n, CAST(list_sum(list_transform(p[1:n + 1], lambda x: strlen(x))) + n * {len(TERM)} AS INTEGER) AS start, CAST(list_sum(list_transform(p[1:n + 1], lambda x: strlen(x))) + (n + 1) * {len(TERM)} AS INTEGER) AS "end"
        FROM (SELECT *, unnest(range(0, len(p) - 1)) AS n FROM pieces)""",
    "longest_prefix_source": f"""WITH s(name, path) AS (VALUES {', '.join(f"('{n}', '{p.rstrip('/')}')" for n, p in SOURCES)}), f AS (SELECT '/' || source || '/' || lang || '/doc_' || doc_id AS file_path FROM documents)
        SELECT file_path, coalesce(arg_max(name, length(path)), '') AS source_name, substring(file_path, coalesce(max(length(path)), -2) + 2) AS rel_path FROM f LEFT JOIN s ON starts_with(file_path, path || '/') GROUP BY file_path""",
    "interval_join_chunks": f"{TEXT_CHUNKS}, {exact_sql()}, {MATCHED} SELECT file_path, line_number, chunk_id FROM matched",
    "vector_cosine": f"SELECT e.vec_id AS chunk_id, round({_COSINE}::FLOAT::DOUBLE, 5) AS score, round(list_cosine_similarity(CAST(e.embedding[1:32] AS DOUBLE[]), CAST(q.embedding[1:32] AS DOUBLE[]))::FLOAT::DOUBLE, 5) AS half_score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "vector_top_k": f"WITH {HITS} SELECT vec_id AS chunk_id, round(score::DOUBLE, 5) AS score, rank FROM near WHERE rank < 50",
    "l2_normalize": "SELECT chunk_id, CAST(i AS INTEGER) AS slot, round((e[i + 1] / sqrt(list_inner_product(e, e)))::FLOAT::DOUBLE, 5) AS x FROM (SELECT chunk_id, e, unnest(range(0, len(e))) AS i FROM (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(CAST(x * 3 AS FLOAT) AS DOUBLE)) AS e FROM embeddings))",
    "tokenize": r"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, min(token) AS least, max(token) AS greatest FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\pL\pN_]+')) AS token FROM documents) GROUP BY doc_id",
    "hash_embed_tokens": rf"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[\pL\pN_]+')) AS token FROM benchmark), h AS (SELECT token, {FNV} AS h FROM t) SELECT token, CAST(h % 384 AS BIGINT) AS slot, CASE WHEN (h // 256) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, CAST((h // 65536) % 384 AS BIGINT) AS second_slot FROM h",
    "hash_embed": rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN_]+') AS w FROM benchmark),
        t AS (SELECT item_id, unnest(w) AS token, 1.0::DOUBLE AS weight FROM b UNION ALL SELECT item_id, w[i] || '_' || w[i + 1], 0.5::DOUBLE FROM (SELECT *, unnest(range(1, len(w))) AS i FROM b)),
        h AS (SELECT item_id, weight, {FNV} AS h FROM t),
        p AS (SELECT item_id, h % 384 AS slot, CASE WHEN (h // 256) % 2 = 1 THEN weight ELSE -weight END AS x FROM h UNION ALL SELECT item_id, (h // 65536) % 384, 0.5 * weight FROM h)
        SELECT item_id, CAST(slot AS BIGINT) AS slot, sum(x) AS x FROM p GROUP BY item_id, slot HAVING sum(x) <> 0""",
    "rrf_fuse": f"{TEXT_CHUNKS}, {exact_sql()}, {MATCHED}, {FUSED} SELECT chunk_id, round(score, 9) AS score, semantic_rank, exact_rank, source_name, start_line FROM fused",
    "search_hybrid": f"{TEXT_CHUNKS}, {exact_sql()}, {MATCHED}, {FUSED}, fetched AS (SELECT * FROM fused WHERE source_name = 'src0' ORDER BY score DESC, chunk_id LIMIT 100) SELECT chunk_id, round(score, 9) AS score FROM fetched WHERE NOT starts_with(chunk_id, 'exact:') ORDER BY fetched.score DESC, chunk_id LIMIT 10",
    "search_exact": f"WITH {DOCS}, {exact_sql(limit=50, where=chr(39).join(['source_name = ', 'src0', '']))} SELECT file_path, line_number, CASE WHEN length(line_text) > 220 THEN left(line_text, 217) || '...' ELSE line_text END AS snippet, 'text' AS kind FROM hits ORDER BY rank LIMIT 10",
    "search_semantic": f"WITH {HITS} SELECT vec_id AS chunk_id, rank, lang AS language FROM near JOIN documents ON doc_id = vec_id WHERE rank < 50 AND lang IN ('fr', 'en') ORDER BY rank LIMIT 10",
    "filters": f"WITH {DOCS} SELECT 'language' AS filter, file_path FROM docs JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') UNION ALL SELECT 'kind', file_path FROM docs UNION ALL SELECT 'dir', file_path FROM docs WHERE contains(file_path, 'src1/') UNION ALL SELECT 'source', file_path FROM docs WHERE source_name = 'src2'",
    "sync_diff": f"{STATE} SELECT * FROM diff",
    "sync_remove": f"{STATE} SELECT rel_path, unnest(['c_' || rel_path, 'd_' || rel_path]) AS id FROM state JOIN diff USING (source_name, rel_path) WHERE status = 'unchanged'",
    "sync_merge": f"{STATE}, new AS (SELECT rel_path, 'c_' || rel_path AS id FROM diff WHERE status IN ('new', 'changed')), old AS (SELECT rel_path, unnest(['c_' || rel_path, 'd_' || rel_path]) AS id FROM state) SELECT rel_path, id, 'old' AS made FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT rel_path, id, 'new' FROM new",
    "sync_state": f"{STATE} SELECT s.source_name, s.rel_path, s.content_hash, strftime(s.modified_at, '%Y-%m-%d') AS day, 'c_' || s.rel_path || ',d_' || s.rel_path AS chunk_ids FROM state s JOIN diff d USING (source_name, rel_path) WHERE status = 'unchanged' UNION ALL SELECT n.source_name, n.rel_path, n.content_hash, strftime(n.modified_at, '%Y-%m-%d'), 'n_' || n.rel_path FROM now n JOIN diff d USING (source_name, rel_path) WHERE status IN ('new', 'changed')",
    "status_counts": f"{STATE}, s(name, enabled) AS (VALUES ('src0', true), ('src1', false), ('none', true)) SELECT name, enabled, count(state.rel_path) AS files FROM s LEFT JOIN state ON source_name = name GROUP BY ALL",
}
