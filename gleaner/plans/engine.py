"""The retrieval engine: index, sync, search and status over bundles."""

from __future__ import annotations

import importlib.util
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import MODELS
from ..functions.text import chunking_hash, content_hash, kind_of_path, language_of_path, snippet
from ..functions.models import available, embed_here, embedder
from ..functions.vectors import embed_text
from ..operators import maintenance as m
from ..operators import search as s
from ..operators import trigrams
from ..operators.cells import CELL_ROWS, MOST_CELLS
from ..operators.chunking import build_chunks
from ..sources.bundle import Bundle, ModelMismatch
from ..sources.scan import Source, list_files, read_files
from ..sources.shared import remove, small_batches
from .config import Config, ConfigError
from .output import format_size

MODES = ("semantic", "exact", "hybrid")
#: Seconds between reports of progress.
EVERY = 0.5
log = logging.getLogger("gleaner")


def dir_size(path: str) -> int:
    """Bytes of all files below a directory."""
    return sum(os.lstat(os.path.join(top, f)).st_size for top, _, files in os.walk(path) for f in files)


class Engine:
    def __init__(self, spark: SparkSession, config: Config, progress: Callable[[str, int, int], None] | None = None):
        """progress: called with a phase, its tasks that are done and those known; with 1 and 1 once it is over."""
        small_batches(spark)
        self.spark, self.config, self.progress = spark, config, progress
        self.bundle = Bundle(spark, config.bundle_path)
        self.model = MODELS[config.mode]
        self.group = f"gleaner-{uuid.uuid4().hex}"
        self._scans: list[str] = []

    @contextmanager
    def phase(self, what: str) -> Iterator[None]:
        """Jobs of a phase run in the engine's group, named for the user interface; their progress and their time are told."""
        began, over = time.monotonic(), threading.Event()
        self.spark.sparkContext.setJobGroup(self.group, what, interruptOnCancel=True)
        teller = threading.Thread(target=self._tell, args=(what, over), daemon=True)
        if self.progress:
            teller.start()
        try:
            yield
            log.debug("%s took %.1f s", what, time.monotonic() - began)
        finally:
            over.set()
            if self.progress:
                teller.join()
                self.progress(what, 1, 1)
            for key in ("spark.jobGroup.id", "spark.job.description"):
                self.spark.sparkContext.setLocalProperty(key, None)

    def _tell(self, what: str, over: threading.Event) -> None:
        """Finished and known tasks of the group's running stages, now and then."""
        tracker = self.spark.sparkContext.statusTracker()
        while not over.wait(EVERY):
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
            stages = [tracker.getStageInfo(i) for j in jobs if j and j.status == "RUNNING" for i in j.stageIds]
            known = [x for x in stages if x]
            if known:
                self.progress(what, sum(x.numCompletedTasks for x in known), sum(x.numTasks for x in known))

    def cancel(self) -> None:
        """End what the engine is running, from another thread; a bundle that is being written stays as it was."""
        self.spark.sparkContext.cancelJobGroup(self.group)

    @classmethod
    def init(cls, spark: SparkSession, base_dir: str, force: bool = False, **settings) -> Engine:
        config = Config(base_dir, **settings)
        if os.path.exists(config.file) and not force:
            raise ConfigError("already initialized")
        config.save()
        out = cls(spark, config)
        out.bundle.initialize(out.model)
        return out

    def add_source(self, path: str, name: str) -> Source:
        source = Source(name, os.path.abspath(path))
        if not os.path.isdir(source.path):
            raise ConfigError(f"no directory {source.path}")
        self.config.sources.append(source)
        try:
            self.config.save()
        except ConfigError:
            self.config.sources.remove(source)
            raise
        return source

    def remove_source(self, name: str) -> None:
        if name not in [x.name for x in self.config.sources]:
            raise ConfigError(f"no source {name}")
        self.config.sources = [x for x in self.config.sources if x.name != name]
        self.config.save()

    def sources(self) -> list[Source]:
        return sorted(self.config.sources, key=lambda x: x.name)

    # -- indexing ---------------------------------------------------------

    @contextmanager
    def listing(self, only: str = "") -> Iterator[DataFrame]:
        """What is in the sources now: paths, sizes and times, kept until the end of the block."""
        work = f"{self.bundle.path}/scan-{uuid.uuid4().hex}"
        try:
            yield list_files(self.spark, self.config.sources, only, defaults=self.config.ignore, use_gitignore=self.config.use_gitignore, work=work)
        finally:
            remove(self.spark, work)

    def scan(self, only: str = "") -> DataFrame:
        """Documents of the sources; their listing stays in the shared folder, since the result reads it."""
        return _hashed(read_files(list_files(self.spark, self.config.sources, only, defaults=self.config.ignore, use_gitignore=self.config.use_gitignore)))

    def by_model(self) -> bool:
        """Whether a model's files are there; if not, words are hashed."""
        return available(self.model_folder(self.model.mode))

    def embed(self, chunks: DataFrame, by_model: bool | None = None) -> DataFrame:
        """source_name, rel_path, chunk_id, vector, hashed (whether the model failed on it); ids travel with the texts, so nothing is paired by position."""
        folder = self.model_folder(self.model.mode)
        if by_model is None:
            by_model = self.by_model()
        if not by_model:
            log.warning("no files of %s in %s: words are hashed", self.model.name, folder)
        text = F.concat(F.lit(self.model.document_prefix), "content")
        made = chunks.select("source_name", "rel_path", F.col("id").alias("chunk_id"), embedder(self.model, self.spark, folder if by_model else None)(text).alias("x"))
        return made.select("source_name", "rel_path", "chunk_id", "x.vector", "x.hashed")

    def model_folder(self, mode: str) -> str:
        return os.path.join(self.config.base_dir, "models", mode)

    def _hash(self) -> str:
        c = self.config.chunking
        return chunking_hash(c.max_chars, c.overlap_chars, c.min_chars, c.respect_headings)

    def _write(self, begun: dict, segment: str, docs: DataFrame, files: DataFrame | None, dead: DataFrame | None, by_model: bool, **about) -> dict:
        """A segment of documents: chunks first, vectors and state from them; files: their listing, if they were listed; dead: files whose earlier rows go."""
        with self.phase("chunks"):
            chunks = self.bundle.put(segment, "chunks", build_chunks(docs, self.config.chunking))
        with self.phase("trigrams"):
            self.bundle.put(segment, "grams", trigrams.postings(docs))
        with self.phase("vectors"):
            n = min(MOST_CELLS, 1 + chunks.count() // CELL_ROWS)
            # directions for cells: a sample of the chunks by hash, embedded twice, rather than all vectors written twice
            sample = self.embed(chunks.orderBy("id").limit(n), by_model).select("vector").collect()  # MOST_CELLS rows at most
            self.bundle.put_vectors(segment, self.embed(chunks, by_model), [r["vector"] for r in sample])
        with self.phase("state"):
            self.bundle.put(segment, "state", m.records_by_file(docs, chunks) if files is None else m.records_of_files(files, chunks))
            gone = 0 if dead is None else self.bundle.put(segment, "dead", dead).count()
            about |= {"tables": ["grams"], "embedded": "model" if by_model else "hash"}
            out = self.bundle.note(segment, gone, begun, self.model, self._hash(), [asdict(x) for x in self.config.sources if x.enabled], dead is None, **about)
        if out["hashed_count"]:
            log.warning("%d vectors are hashed words, since the model failed on their texts", out["hashed_count"])
        return out

    def rebuild(self, docs: DataFrame | None = None, only: str = "") -> dict:
        """Index everything anew; with ``only``, the bundle then holds that source alone."""
        begun, segment = self.bundle.begin()
        if docs is not None:
            return self._write(begun, segment, _hashed(docs), None, None, self.by_model())
        with self.listing(only) as files:
            return self._write(begun, segment, read_files(files), files, None, self.by_model())

    def index(self, full: bool = False, only: str = "", docs: DataFrame | None = None) -> dict:
        """Full if asked for, if nothing is indexed, or if model or chunking changed; else a sync.  docs: instead of the sources."""
        manifest = self.bundle.manifest()
        stale = not manifest["segments"] or manifest["chunking_hash"] != self._hash() or manifest["model"]["mode"] != self.model.mode or (manifest["embedded"] == "model") != self.by_model()
        return self.rebuild(docs, only) if full or stale else self.sync(docs, only)

    def sync(self, docs: DataFrame | None = None, only: str = "") -> dict:
        """Bring the bundle up to date by a segment of what is new or changed; with ``only``, other sources are left as they are.

        Without ``docs``, sources are listed, and only files that are new or of another time are read.
        """
        begun, segment = self.bundle.begin()
        if not begun["segments"]:
            return self.rebuild(docs, only)
        self._suits(begun)
        state = self.bundle.live("state", begun)
        scope = state.filter(F.col("source_name") == only) if only else state
        if docs is not None:
            docs = _hashed(docs)
            return self._sync(begun, segment, docs, None, m.state_diff(docs, scope))
        with self.listing(only) as files:
            files = m.files_by_time(files, scope)
            read = files.filter("not same").drop("same")
            touched = _hashed(read_files(read))
            return self._sync(begun, segment, touched, read, m.listed_diff(files, touched, scope))

    def _suits(self, begun: dict) -> None:
        if begun["model"]["mode"] != self.model.mode:
            raise ModelMismatch(f"indexed with {begun['model']['mode']}, not {self.model.mode}: rebuild")
        if begun["embedded"] == "model" and not self.by_model():
            raise ModelMismatch(f"indexed by {self.model.name}, whose files aren't in {self.model_folder(self.model.mode)}: rebuild to hash words")

    def upsert(self, docs: DataFrame, **about) -> dict:
        """Put documents in the place of what the bundle has of their files, whatever that is: it isn't read.  about: what the manifest keeps with it."""
        begun, segment = self.bundle.begin()
        docs = _hashed(docs)
        if not begun["segments"]:
            return self._write(begun, segment, docs, None, None, self.by_model(), **about)
        self._suits(begun)
        self._write(begun, segment, docs, None, docs.select(*m.KEY).distinct(), begun["embedded"] == "model", counted=False, **about)
        return self.bundle.compact()

    def _sync(self, begun: dict, segment: str, docs: DataFrame, files: DataFrame | None, diff: DataFrame) -> dict:
        with self.phase("differences"):
            diff = self.bundle.put(segment, "diff", diff)
            counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}  # four rows at most
        out = {k: counts.get(k, 0) for k in ("new", "changed", "deleted", "unchanged")}
        log.debug("%(new)d new, %(changed)d changed, %(deleted)d deleted, %(unchanged)d unchanged", out)
        if not counts.keys() - {"unchanged"}:
            self.bundle.abandon(segment)
            return begun | out
        dead = diff.filter(F.col("status").isin("changed", "deleted")).select(*m.KEY)
        listed = None if files is None else m.files_to_process(files, diff)
        self._write(begun, segment, m.files_to_process(docs, diff), listed, dead, begun["embedded"] == "model")
        with self.phase("compaction"):
            return self.bundle.compact() | out

    # -- searching --------------------------------------------------------

    def query_vector(self, query: str) -> list[float]:
        model = MODELS[self.bundle.manifest()["model"]["mode"]]  # the bundle's, not the configuration's
        if self.bundle.manifest()["embedded"] == "model":  # with hashed words, no vector would be near
            return embed_here(model.query_prefix + query, model, self.model_folder(model.mode)).tolist()
        return embed_text(model.query_prefix + query, model.dimension, model.normalize).tolist()

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, source: str = "", language: str = "", kind: str = "", directory: str = "", documents: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
        """Results, best first.  Filters come after the fetch limit, unless ``prefilter``.  Lines are searched in ``documents`` or else in the
        sources, whose listing is kept until ``forget``."""
        if mode not in MODES:
            raise ValueError(f"the mode must be one of {', '.join(MODES)}")
        limit = limit if limit > 0 else 10
        chunks = self.bundle.chunks()
        if prefilter:
            chunks = s.filtered(chunks, language, kind, directory, source)
        if mode == "exact":
            found = self.exact(query, 5 * limit, source, documents)
            fetch = 5 * limit
        elif mode == "semantic":
            fetch = s.semantic_fetch(limit)
            hits, few = s.held(self._nearest(query, fetch, chunks if prefilter else None))
            found = (F.broadcast(hits) if few else hits).join(chunks, F.col("chunk_id") == F.col("id")).select(
                "chunk_id", "file_path", "rel_path", snippet(F.col("content")).alias("snippet"), F.col("score").cast("double").alias("score"), F.col("rank").alias("semantic_rank"), F.lit(-1).alias("exact_rank"),
                "source_name", "kind", "language", "title", "start_line", "end_line", "function_name", "section_level",
            )
        else:
            fetch = s.hybrid_fetch(limit)
            hits = self._nearest(query, fetch, chunks if prefilter else None)
            docs = self._documents(documents, source, query)
            found = s.rrf_fuse(hits, s.exact_lines(docs, query, fetch), chunks)
        order = [F.desc("score"), F.asc("semantic_rank"), F.asc("chunk_id")] if mode == "semantic" else [F.asc("exact_rank")] if mode == "exact" else [F.desc("score"), F.asc("chunk_id")]
        fetched = s.filtered(found, source=source).orderBy(*order).limit(fetch)
        return s.filtered(fetched, language, kind, directory).orderBy(*order).limit(limit)

    def _nearest(self, query: str, k: int, chunks: DataFrame | None) -> DataFrame:
        """The k nearest vectors, of some chunks or by cells of all."""
        if chunks is None:
            return self.bundle.nearest(self.query_vector(query), k)[0]
        return s.vector_top_k(self.bundle.embeddings().join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), self.query_vector(query), k)

    def _documents(self, documents: DataFrame | None, source: str, pattern: str) -> DataFrame:
        """What may hold lines of a pattern: indexed files that hold its trigrams, and all whose time isn't the indexed one."""
        rows = documents
        if documents is None:
            self._scans.append(f"{self.bundle.path}/scan-{uuid.uuid4().hex}")
            rows = list_files(self.spark, self.config.sources, source, defaults=self.config.ignore, use_gitignore=self.config.use_gitignore, work=self._scans[-1])
        if source:
            rows = rows.filter(F.col("source_name") == source)
        manifest, asked = self.bundle.manifest(), trigrams.condition(pattern)
        if asked and "grams" in manifest.get("tables", []):
            rows = trigrams.worth_searching(m.files_by_time(rows, self.bundle.live("state", manifest)), "same", self.bundle.grams(manifest), asked).drop("same")
        return read_files(rows) if documents is None else rows

    def forget(self) -> None:
        """Delete the listings that results of searches read; ``respond`` does so itself."""
        while self._scans:
            remove(self.spark, self._scans.pop())

    def exact(self, query: str, limit: int, source: str = "", documents: DataFrame | None = None) -> DataFrame:
        lines = s.exact_lines(self._documents(documents, source, query), query, limit)
        return lines.select(
            F.lit("").alias("chunk_id"), "file_path", "rel_path", snippet(F.col("line_text")).alias("snippet"), F.lit(1.0).alias("score"), F.lit(-1).alias("semantic_rank"), F.col("rank").alias("exact_rank"),
            "source_name", kind_of_path(F.col("file_path")).alias("kind"), language_of_path(F.col("file_path")).alias("language"),
            F.lit("").alias("title"), F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), F.lit("").alias("function_name"), F.lit(0).cast("long").alias("section_level"),
            F.transform("submatches", lambda x: F.struct((x["start"] - F.col("lead")).alias("start"), (x["end"] - F.col("lead")).alias("end"))).alias("matched_terms"),
        )

    def respond(self, query: str, mode: str = "hybrid", **how) -> dict:
        began = time.monotonic()
        with self.phase(f"search ({mode})"):
            rows = self.search(query, mode, **how).collect()  # at most the limit
        self.forget()
        filters = {"source": how.get("source", ""), "language": how.get("language", ""), "kind": how.get("kind", ""), "dir": how.get("directory", "")}
        results = [
            {
                **{k: r[k] for k in ("chunk_id", "file_path", "snippet", "score", "source_name")},
                "metadata": {"file_kind": r["kind"], **{k: r[k] for k in ("language", "title", "start_line", "end_line", "function_name", "section_level")}},
                "matched_terms": _characters(r["snippet"], r["matched_terms"]) if mode == "exact" else [],
            }
            for r in rows
        ]
        return {"query": query, "mode": mode, "filters": filters, "results": results, "total": len(results), "elapsed_ms": round(1000 * (time.monotonic() - began))}

    # -- state ------------------------------------------------------------

    def files_per_source(self) -> DataFrame:
        named = self.spark.createDataFrame([(x.name, x.enabled) for x in self.sources()], "name string, enabled boolean")
        return m.count_files_per_source(self.bundle.state(), named).orderBy("name")

    def status(self) -> dict:
        """Bundle, time of indexing, model, files of each source, totals, and whether there is any state."""
        found = self.bundle.manifest()
        found |= self.bundle.counts(found)
        when = found.get("indexed_at")
        counts = {r["name"]: r["files"] for r in self.files_per_source().collect()}  # a row for each source
        return {
            "bundle": self.config.bundle, "indexed_at": datetime.fromisoformat(when).strftime("%Y-%m-%d %H:%M:%S") if when else "never", "mode": found["model"]["mode"], "model": found["model"]["name"],
            "sources": [(x["name"], counts.get(x["name"], 0)) for x in found["sources"]], "files": found.get("file_count", 0), "chunks": found.get("chunk_count", 0), "embeddings": found.get("embedding_count", 0), "state": "indexed" if found.get("file_count") else "empty (run index)",
        }

    def doctor(self) -> list[tuple[str, str, str, str]]:
        """(check, ok or warn or fail, message, hint)."""
        out = [("spark", "ok", f"Spark {self.spark.version} on {self.spark.sparkContext.master}", "")]
        runtime = importlib.util.find_spec("onnxruntime") is not None
        out.append(("model runtime", "ok", "found", "") if runtime else ("model runtime", "warn", "not found; hashed words stand in", "install onnxruntime"))
        for mode, model in MODELS.items():
            folder = self.model_folder(mode)
            out.append((f"model {mode}", "ok", f"{model.name}, {format_size(dir_size(folder))}", "") if available(folder) else (f"model {mode}", "warn", "no files; hashed words stand in", f"put {model.name} into {folder}"))
        try:
            self.config.validate()
            out.append(("config", "ok", self.config.file, ""))
        except ConfigError as e:
            out.append(("config", "fail", str(e), "mend the file, or init --force"))
        enabled = [x for x in self.sources() if x.enabled]
        if not enabled:
            out.append(("sources", "warn", f"{len(self.config.sources)} configured, none enabled", "source add PATH --name NAME"))
        for x in enabled:
            there = os.path.isdir(x.path)
            out.append((f"source {x.name}", "ok" if there else "warn", x.path, "" if there else "see that the path exists and can be read"))
        try:
            found = self.bundle.manifest()
            out.append(("bundle", "ok" if found["segments"] else "warn", f"{found.get('chunk_count', 0)} chunks, {format_size(self.bundle.size())}", "" if found["segments"] else "run index"))
        except FileNotFoundError as e:
            out.append(("bundle", "fail", str(e), "run init"))
        return out


def _hashed(docs: DataFrame) -> DataFrame:
    return docs if "content_hash" in docs.columns else docs.withColumn("content_hash", content_hash(F.col("content")))


def _characters(text: str, terms: list | None) -> list[tuple[int, int]]:
    """Ranges of bytes as ranges of characters, those that lie in the text."""
    raw = text.encode()
    return [(len(raw[: x["start"]].decode(errors="ignore")), len(raw[: x["end"]].decode(errors="ignore"))) for x in terms or [] if 0 <= x["start"] < x["end"] <= len(raw)]
