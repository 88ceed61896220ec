"""A bundle: segments of chunks, embeddings and state as Parquet, and a manifest that names the current ones.

A rebuild makes one segment.  A sync makes a small one: what is new or changed, and a list of the files
whose rows in earlier segments are dead (tombstones).  Segments have serial numbers; a row is live
if no later segment declares its file dead, so a file may go, come back and go again.  When the
newest segments have grown to the size of the one before them, or much is dead, a run of neighbours is compacted
into one: every row is rewritten a logarithmic number of times at most.

A write makes its segment's folder first and then replaces the manifest, so readers see all of
it or none, and a write that breaks off leaves nothing but a folder that the next one deletes.  Segments
that a write makes superfluous stay until the write after it, for readers whose plans still name them.
One writer at a time: a manifest that has changed since a write began isn't replaced.  Tables and manifest go
through the same file system, that of the bundle's path.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import Model
from ..operators.cells import CELL_ROWS, MOST_CELLS, cells_of, centres_of, top_k_by_cells, with_cells

CHUNKS = "id string, source_name string, file_path string, rel_path string, content string, start_line long, end_line long, chunk_index long, kind string, extension string, language string, title string, headings_json string, byte_size long, content_hash string, created_at timestamp, function_name string, section_level long"
EMBEDDINGS = "chunk_id string, vector array<float>"
STATE = "source_name string, rel_path string, content_hash string, modified_at timestamp, byte_size long, chunk_ids array<string>"
KEY = ["source_name", "rel_path"]
#: What a segment's tables hold; embeddings with their file, whether words were hashed in the model's stead, and their cell.
TABLES = {"chunks": CHUNKS, "embeddings": f"source_name string, rel_path string, {EMBEDDINGS}, hashed boolean, far float, cell int", "cells": "cell int, n long, radius float, centre array<float>", "state": STATE, "dead": "source_name string, rel_path string", "grams": "gram long, files array<long>"}
_TEXTS, _NUMBERS = ("language", "title", "headings_json", "function_name"), ("section_level",)
#: Neighbouring segments that are worth compacting; a segment joins those after it up to this many times their size.
RUN, FACTOR = 4, 1.5


class IndexNotFound(FileNotFoundError):
    pass


class ModelMismatch(ValueError):
    pass


class Conflict(RuntimeError):
    pass


def run_to_compact(sizes: list[int], dead: int, files: int) -> tuple[int, int] | None:
    """First and last of the segments to make one, if any; sizes: bytes of each, oldest first."""
    if len(sizes) > 1 and dead > files:
        return 0, len(sizes) - 1
    low = len(sizes) - 1
    total = sizes[low] if sizes else 0
    while low > 0 and sizes[low - 1] <= FACTOR * total:
        low -= 1
        total += sizes[low]
    return (low, len(sizes) - 1) if len(sizes) - low >= RUN else None


class Bundle:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    @property
    def _files(self):
        return self._place("").getFileSystem(self._conf)

    def initialize(self, model: Model) -> None:
        if not self.exists():
            self._save({"version": "0.3.0", "serial": 0, "segments": [], "previous": [], "model": asdict(model), "chunking_hash": "", "sources": []})

    def exists(self) -> bool:
        return self._files.exists(self._place("manifest.json"))

    def manifest(self) -> dict:
        if not self.exists():
            raise IndexNotFound(f"no index in {self.path}")
        stream = self._files.open(self._place("manifest.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return {"serial": 0, "segments": [], "previous": []} | found  # one of an older form has nothing indexed

    def _save(self, manifest: dict) -> None:
        fresh, place = self._place("manifest.json.new"), self._place("manifest.json")
        stream = self._files.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest, indent=2).encode()))
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        self._hadoop.FileContext.getFileContext(place.toUri() if place.isAbsolute() and place.toUri().getScheme() else self._files.getUri(), self._conf).rename(fresh, place, options)

    def size(self, name: str = "") -> int:
        """Bytes of the bundle's files, or of those of a segment."""
        return self._files.getContentSummary(self._place(name)).getLength()

    # -- reading ------------------------------------------------------------------

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{segment}/{name}")

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """The files that segments declare dead, with the last serial that does."""
        listed = [self._table(x["name"], "dead").withColumn("_dead", F.lit(x["serial"])) for x in segments if x["dead"]]
        return reduce(DataFrame.unionByName, listed).groupBy(*KEY).agg(F.max("_dead").alias("_dead")) if listed else None

    def live(self, name: str, manifest: dict | None = None, run: slice = slice(None), keep=lambda segment, rows: rows) -> DataFrame:
        """A table's live rows, of all segments or of a run of them; keep: what is read of a segment's rows."""
        segments = (manifest or self.manifest())["segments"]
        if not segments:
            raise IndexNotFound(f"nothing is indexed in {self.path}")
        parts = [keep(x, self._table(x["name"], name)).withColumn("_serial", F.lit(x["serial"])) for x in segments[run]]
        rows, dead = reduce(DataFrame.unionByName, parts), self._dead(segments[(run.start or 0) + 1 :])
        if dead is not None:
            rows = rows.join(dead, KEY, "left").filter(F.col("_dead").isNull() | (F.col("_serial") >= F.col("_dead")))
        return rows.select(*self._table(segments[0]["name"], name).columns)

    def chunks(self) -> DataFrame:
        out = self.live("chunks")
        return out.withColumns({c: F.coalesce(c, F.lit("")) for c in _TEXTS} | {c: F.coalesce(c, F.lit(0)) for c in _NUMBERS})

    def embeddings(self) -> DataFrame:
        return self.live("embeddings").select("chunk_id", "vector")

    def nearest(self, query: list[float], k: int) -> tuple[DataFrame, float]:
        """chunk_id, score, rank of the k nearest vectors, and the share of all that were read for it."""
        manifest = self.manifest()
        segments = {x["name"]: x for x in manifest["segments"]}
        listed = reduce(DataFrame.unionByName, [self._table(n, "cells").withColumn("segment", F.lit(n)) for n in segments])
        cells = listed.collect()  # MOST_CELLS + 1 rows of a segment at most

        def read(some: list) -> DataFrame:
            wanted: dict[str, list[int]] = {}
            for c in some:
                wanted.setdefault(c["segment"], []).append(c["cell"])
            keep = lambda x, rows: rows.filter(F.col("cell").isin(wanted.get(x["name"], []))) if len(wanted.get(x["name"], [])) else rows.filter("false")
            return self.live("embeddings", manifest, keep=keep).select("chunk_id", "vector")

        return top_k_by_cells(read, cells, query, k)

    def state(self) -> DataFrame:
        """Empty if there is none."""
        try:
            return self.live("state")
        except IndexNotFound:
            return self.spark.createDataFrame([], STATE)

    def grams(self, manifest: dict | None = None) -> DataFrame:
        """Postings of all segments; those of files that are dead or changed find what a search then doesn't."""
        return reduce(DataFrame.unionByName, [self._table(x["name"], "grams") for x in (manifest or self.manifest())["segments"]])

    def counts(self, manifest: dict) -> dict:
        """Files, chunks and embeddings: the manifest's, or counted if a write has left that out."""
        if not manifest["segments"] or manifest.get("counted_at") == manifest["serial"]:
            return {k: manifest.get(k, 0) for k in ("file_count", "chunk_count", "embedding_count")}
        files, chunks = self.live("state", manifest).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0))).first()
        return {"file_count": files, "chunk_count": chunks, "embedding_count": chunks}

    # -- writing ------------------------------------------------------------------

    def begin(self) -> tuple[dict, str]:
        """The manifest that a write starts from, and the name of the segment that it makes."""
        manifest = self.manifest()
        return manifest, f"s{manifest['serial'] + 1:06d}"

    def put_vectors(self, segment: str, vectors: DataFrame, sample: list) -> None:
        """Write embeddings (but for far and cell) in cells around directions of a sample, and the cells."""
        centres = centres_of(sample, MOST_CELLS)
        rows = with_cells(vectors, centres)
        # a cell's rows go to a few tasks, so that its folder holds few files; more than 4 only where cells can be larger than CELL_ROWS
        parts = 32 if len(centres) >= MOST_CELLS else min(len(centres), 4)
        written = self.put(segment, "embeddings", rows.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))) if len(centres) > 1 else rows)
        self.put(segment, "cells", cells_of(written, centres))

    def put(self, segment: str, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of a segment and read it back."""
        columns = [x.split()[0] for x in TABLES[name].split(", ")] if name in TABLES else rows.columns
        writer = rows.select(*columns).write.mode("overwrite")
        path = f"{self.path}/{segment}/{name}"
        by = {"chunks": "source_name", "embeddings": "cell"}.get(name)
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self._table(segment, name) if name in TABLES else self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, begun: dict, segment: str, dead: int, replaces: range, serial: int | None = None, **about) -> dict:
        """Name a written segment in the manifest, in the place of those that it replaces; then delete what no reader can need.

        serial: that of the rows, if they are older than the write.
        """
        if self.manifest()["serial"] != begun["serial"]:
            raise Conflict(f"{self.path} has been written to since")
        own, now = begun["segments"], begun["serial"] + 1
        new = {"name": segment, "serial": now if serial is None else serial, "dead": dead, "bytes": self.size(segment), "vectors": self._table(segment, "cells").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
        kept = [*own[: replaces.start], new, *own[replaces.stop :]]
        manifest = begun | about | {"version": "0.3.0", "serial": now, "segments": kept}
        manifest["previous"] = [x["name"] for x in own if x not in kept]
        if manifest.pop("counted", True):
            manifest["counted_at"] = -1
            manifest |= self.counts(manifest) | {"counted_at": now}
        self._save(manifest)
        needed = {x["name"] for x in kept} | set(manifest["previous"])
        for x in self._files.listStatus(self._place("")):
            name = x.getPath().getName()
            if x.isDirectory() and name[:1] in "sv" and name[1:].isdigit() and name not in needed:
                self._files.delete(x.getPath(), True)
        return manifest

    def note(self, segment: str, dead: int, begun: dict, model: Model, chunking_hash: str, sources: list[dict], whole: bool, **about) -> dict:
        """Commit a segment of a rebuild (whole) or of a sync."""
        about |= {"model": asdict(model), "chunking_hash": chunking_hash, "indexed_at": datetime.now(timezone.utc).isoformat(), "sources": sources, "source_count": len(sources)}
        about["hashed_count"] = (0 if whole else begun.get("hashed_count", 0)) + self._table(segment, "embeddings").filter("hashed").count()
        n = len(begun["segments"])
        return self.commit(begun, segment, dead, range(0 if whole else n, n), **about)

    def compact(self, whole: bool = False) -> dict:
        """Make one segment of a run of them, if one is due or ``whole`` is asked for."""
        manifest, segment = self.begin()
        own = manifest["segments"]
        due = (0, len(own) - 1) if whole and len(own) > 1 else run_to_compact([x["bytes"] for x in own], sum(x["dead"] for x in own), manifest.get("file_count", 0))
        if due is None:
            return manifest
        run = slice(due[0], due[1] + 1)
        for name in ("chunks", "state"):
            self.put(segment, name, self.live(name, manifest, run))
        vectors = self.live("embeddings", manifest, run).drop("far", "cell")
        n = min(MOST_CELLS, 1 + sum(x["vectors"] for x in own[run]) // CELL_ROWS)
        sample = vectors.orderBy(F.xxhash64("chunk_id")).limit(n).select("vector").collect()  # MOST_CELLS rows at most
        self.put_vectors(segment, vectors, [r["vector"] for r in sample])
        if "grams" in manifest.get("tables", []):
            self.put(segment, "grams", reduce(DataFrame.unionByName, [self._table(x["name"], "grams") for x in own[run]]).orderBy("gram"))
        dead = 0
        if due[0]:  # earlier segments may hold rows of the files that the run declares dead
            dead = self.put(segment, "dead", self._dead(own[run]).select(*KEY)).count() if any(x["dead"] for x in own[run]) else 0
        return self.commit(manifest, segment, dead, range(run.start, run.stop), own[run][-1]["serial"])

    def abandon(self, segment: str) -> None:
        """Delete the folder of a segment that was begun in vain."""
        self._files.delete(self._place(segment), True)
