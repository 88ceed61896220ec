"""Directories as tables of documents.

Executors list directories, level by level, and prune ignored ones: a task walks down from a directory until it has seen
BUDGET entries and hands on the directories that are left, with the ignore rules that hold there.  The listing is a table
of paths, sizes and times; contents are read from such a table, so whoever needs no contents opens no files.
Paths are local ones that all executors see, or those of a store that Arrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import work_dir

DOCUMENTS = "source_name string, source_path string, abs_path string, rel_path string, extension string, content string, byte_size long, modified_at timestamp"
FILES = "source_name string, source_path string, abs_path string, rel_path string, byte_size long, modified_at timestamp"
#: Entries that a task lists before it hands directories on; bytes of contents in a batch and in a partition.
BUDGET, BATCH_BYTES, PARTITION_BYTES = 10_000, 8 << 20, 64 << 20
# What a scan leaves out by default, and the extensions of a new source.
IGNORED = (".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".idea", ".vscode", ".obsidian", "*.min.js", "*.min.css")
EXTENSIONS = ("md", "txt", "go", "rs", "ts", "js", "jsx", "tsx", "py", "toml", "yaml", "yml", "json")


@dataclass
class Source:
    name: str
    path: str
    enabled: bool = True
    include_extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    exclude_patterns: list[str] = field(default_factory=list)


def glob_regex(pattern: str) -> re.Pattern[str]:
    """``*`` and ``?`` stay within a path component, ``**`` doesn't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out + r"\Z", re.S)


class Gitignore:
    """Rules of one ignore file, for paths below its directory; the last rule that fits decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((glob_regex(line.lstrip("/") if anchored else "**/" + line), negated, only_dirs))

    def ignores(self, rel: str, is_dir: bool) -> bool:
        parts = rel.split("/")
        for n in range(1, len(parts) + 1):
            verdict = False
            for regex, negated, only_dirs in self.rules:
                if regex.match("/".join(parts[:n])) and (not only_dirs or n < len(parts) or is_dir):
                    verdict = not negated
            if verdict:
                return True
        return False


def excluded(rel: str, patterns: list[str]) -> bool:
    """A source's own patterns: ``p/**`` for all below p, else a glob on the path or the name."""
    for p in patterns:
        if p.endswith("/**") and (rel == p[:-3] or rel.startswith(p[:-2])):
            return True
        regex = glob_regex(p)
        if regex.match(rel) or regex.match(rel.rpartition("/")[2]):
            return True
    return False


def ignored_by_default(rel: str, patterns: tuple[str, ...] = IGNORED) -> bool:
    """Literals fit any component of a path, globs its last one."""
    parts = rel.split("/")
    return any(fnmatch.fnmatchcase(parts[-1], p) if "*" in p else p in parts for p in patterns)


def opened(path: str) -> tuple[pafs.FileSystem, str] | None:
    """The store of a path with a scheme and the path in it; none for a local path."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else None


def read_bytes(path: str) -> bytes:
    store = opened(path)
    if store:
        with store[0].open_input_stream(store[1]) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def children(path: str) -> Iterator[tuple[str, bool, int, datetime]]:
    """Name, whether a directory, bytes and time of what a directory holds; links to directories aren't followed."""
    store = opened(path)
    if store:
        for x in store[0].get_file_info(pafs.FileSelector(store[1], allow_not_found=True)):
            yield x.base_name, x.type == pafs.FileType.Directory, x.size or 0, x.mtime or datetime.fromtimestamp(0, timezone.utc)
        return
    with os.scandir(path) as found:
        for x in found:
            try:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, True, 0, datetime.fromtimestamp(0, timezone.utc)
                elif x.is_file():
                    about = x.stat()
                    yield x.name, False, about.st_size, datetime.fromtimestamp(about.st_mtime, timezone.utc)
            except OSError:  # gone meanwhile
                continue


def walk(source: Source, root: str, rel: str, rules: list[list[str]], budget: float, defaults: tuple[str, ...], use_gitignore: bool, strict_parity: bool) -> Iterator[tuple[str, int, datetime, list[list[str]] | None]]:
    """(relative path, bytes, time, None) of files below a directory, and (relative path, 0, time, rules) of directories left when the budget is spent.

    rules: [directory, text of its ignore file] for those above that have one.
    """
    wanted = {x.lower().removeprefix(".") for x in source.include_extensions}
    parsed: dict[str, Gitignore] = {}
    stack = [(rel, rules)]
    while stack:
        rel, rules = stack.pop()
        if budget <= 0:
            yield rel, 0, datetime.fromtimestamp(0, timezone.utc), rules
            continue
        found = sorted(children(f"{root}/{rel}" if rel else root))
        budget -= len(found) + 1
        if use_gitignore and any(name == ".gitignore" and not is_dir for name, is_dir, _, _ in found) and not (strict_parity and not rel):
            rules = [*rules, [rel, read_bytes("/".join(filter(None, [root, rel, ".gitignore"]))).decode("utf-8", "replace")]]

        def left_out(path: str, is_dir: bool, rules=rules) -> bool:
            for base, text in rules:
                own = parsed.get(text) or parsed.setdefault(text, Gitignore(text))
                if own.ignores(path[len(base) + 1 :] if base else path, is_dir):
                    return True
            return excluded(path, source.exclude_patterns) or ignored_by_default(path, defaults)

        below = []
        for name, is_dir, size, when in found:
            path = f"{rel}/{name}" if rel else name
            if is_dir:
                if not left_out(path, True):
                    below.append((path, rules))
            elif (name.rpartition(".")[2].lower() if "." in name else "") in wanted and not left_out(path, False):
                yield path, size, when, None
        stack += reversed(below)


def _root(source: Source) -> str:
    return source.path.rstrip("/") if opened(source.path) else os.path.abspath(source.path)


def listed(source: Source, defaults: tuple[str, ...] = IGNORED, use_gitignore: bool = True, strict_parity: bool = False) -> Iterator[tuple[str, str]]:
    """(absolute, relative) paths to read.  strict_parity: leave the root's own ignore file unread."""
    root = _root(source)
    for rel, _, _, _ in walk(source, root, "", [], float("inf"), defaults, use_gitignore, strict_parity):
        yield f"{root}/{rel}", rel


def list_files(spark: SparkSession, sources: list[Source], only: str = "", defaults: tuple[str, ...] = IGNORED, use_gitignore: bool = True, strict_parity: bool = False, work: str | None = None) -> DataFrame:
    """FILES of all enabled sources, or of the one named, without opening any but ignore files; written below ``work``."""
    by_name = {s.name: s for s in sources if s.enabled and (not only or s.name == only)}
    if not by_name:
        return spark.createDataFrame([], FILES)
    work, budget = work or work_dir(spark), BUDGET
    names = [x.split()[0] for x in FILES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.string()] * 4, pa.int64(), pa.timestamp("us", "UTC"), pa.string())
        for b in batches:
            for name, root, rel, rules in zip(*[c.to_pylist() for c in b.columns]):
                rows = []
                for path, size, when, handed in walk(by_name[name], root, rel, json.loads(rules), budget, defaults, use_gitignore, strict_parity):
                    rows.append((name, root, f"{root}/{path}", path, size, when, None if handed is None else json.dumps(handed)))
                    if len(rows) == BUDGET:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "rules"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "rules"])

    level = spark.createDataFrame([(s.name, _root(s), "", "[]") for s in by_name.values()], "source_name string, source_path string, rel_path string, rules string").repartition(len(by_name))
    files = []
    while True:
        path = f"{work}/level-{len(files)}"
        schema = f"{FILES}, rules string"
        level.mapInArrow(run, schema).write.parquet(path)
        found = spark.read.schema(schema).parquet(path)
        files.append(found.filter("rules IS NULL").drop("rules"))
        folders = found.filter("rules IS NOT NULL")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, files)
        level = folders.select("source_name", "source_path", "rel_path", "rules").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_files(files: DataFrame) -> DataFrame:
    """DOCUMENTS of listed files; those that aren't text (a null byte, invalid UTF-8) or are gone are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.string()] * 6, pa.int64(), pa.timestamp("us", "UTC"))
        names = [x.split()[0] for x in DOCUMENTS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows, held = [], 0
        for b in batches:
            for name, top, path, rel, _, when in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    raw = read_bytes(path)
                    text = raw.decode("utf-8")
                except (UnicodeDecodeError, FileNotFoundError):
                    continue
                if "\0" not in text:
                    extension = rel.rpartition(".")[2].lower() if "." in rel.rpartition("/")[2] else ""
                    rows.append((name, top, path, rel, extension, text, len(raw), when))
                    held += len(raw)
                if held > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    files = files.select(*[x.split()[0] for x in FILES.split(", ")])
    total = files.agg(F.coalesce(F.sum("byte_size"), F.lit(0))).first()[0]
    return files.repartition(total // PARTITION_BYTES + min(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, DOCUMENTS)


def scan_sources(spark: SparkSession, sources: list[Source], only: str = "", **how) -> DataFrame:
    """Documents of all enabled sources, or of the one named."""
    return read_files(list_files(spark, sources, only, **how))


def scan_source(spark: SparkSession, source: Source, **how) -> DataFrame:
    return scan_sources(spark, [source], **how)


def table_documents(table: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", extension: str = "txt") -> DataFrame:
    """A table of texts in the shape of a scan."""
    rel = F.concat(F.lit("doc_"), F.col(key).cast("string"), F.lit(f".{extension}"))
    return table.select(
        F.col(source).alias("source_name"), F.concat(F.lit("/"), F.col(source)).alias("source_path"), F.concat(F.lit("/"), F.col(source), F.lit("/"), rel).alias("abs_path"), rel.alias("rel_path"), F.lit(extension).alias("extension"),
        F.col(text).alias("content"), F.octet_length(text).cast("long").alias("byte_size"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("modified_at"),
    )
