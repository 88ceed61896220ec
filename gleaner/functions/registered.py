"""Chunks and embeddings for SQL: a table function and a function, registered with a session.

``chunks(content, source, path)`` gives the chunks of one text as ``build_chunks`` gives those of a table, row by row::

    SELECT c.* FROM docs, LATERAL chunks(content, source_name, rel_path) c

``embed(text)`` gives the vector of a text by hashed words or by a model's files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import BOUNDARIES, Chunking
from .catalog import Model
from .models import embedder
from .text import KINDS, LANGUAGES, WHITE_SPACE

ROWS = "id string, content string, start_line long, end_line long, chunk_index long, kind string, language string, title string, headings_json string, content_hash string, function_name string, section_level long"
#: The white space of the expressions' \\s, and the word characters of their \\w.
_COMPILED = lru_cache(None)(lambda p: re.compile(p, re.ASCII))


def _marks(text: str, kind: str, ext: str) -> list[tuple[int, str, int, int]]:
    """(offset, name, level, line) of headings, or of lines at which code is cut."""
    out, at = [], 0
    for number, line in enumerate(text.split("\n"), 1):
        t = line.strip(WHITE_SPACE)
        if kind == "markdown":
            head = re.match("(#+)(.*)", t, re.S)
            if head and len(head[1]) <= 6 and (name := head[2].strip(WHITE_SPACE)):
                out.append((at, name, len(head[1]), number))
        else:
            found = next((m for p in BOUNDARIES.get(ext, ()) if (m := _COMPILED(p).search(t))), None)
            if found:
                out.append((at, found[1], 0, number))
        at += len(line) + 1
    return out


def chunks_of(text: str | None, source: str, path: str, config: Chunking) -> Iterator[tuple]:
    if not text:
        return
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    kind = next((k for k, es in KINDS.items() if ext in es), "unknown")
    digest = hashlib.sha1(text.encode()).hexdigest()
    marks = _marks(text, kind, ext) if kind in ("markdown", "code") else []
    heads = [m[1] for m in marks] if kind == "markdown" else []
    cuts = marks if kind == "code" or config.respect_headings else []
    whole = [(0, "", 0, 1)]
    sections = [*(whole if kind == "code" and cuts and cuts[0][0] > 0 else []), *cuts] or whole
    step = config.max_chars - config.overlap_chars if config.max_chars > config.overlap_chars else config.max_chars
    windows = []
    for (low, name, level, line), (end, *_) in zip(sections, [*sections[1:], (len(text),)]):
        at = low
        while at < end and config.max_chars > 0:
            raw = text[at : min(at + config.max_chars, end)]
            windows.append((raw.strip(WHITE_SPACE), name if at == low else "", level if at == low else 0, line, line + raw.count("\n")))
            if at + config.max_chars >= end:
                break
            line += raw[:step].count("\n")
            at += step
    kept = [(i, w) for i, w in enumerate(windows) if w[0] and (len(w[0]) >= config.min_chars or i == len(windows) - 1)]
    for i, (body, name, level, first, last) in kept or [(0, (text.strip(WHITE_SPACE), "", 0, 1, 1 + text.count("\n")))]:
        ident = hashlib.sha1(f"{source}|{path}|{i}|{digest}".encode()).hexdigest()
        title = name if name and kind == "markdown" else heads[0] if heads else ""
        yield ident, body, first, last, i, kind, LANGUAGES.get(ext, ""), title, json.dumps(heads, ensure_ascii=False, separators=(",", ":")) if heads else "", digest, name if kind == "code" else "", level if kind == "markdown" else 0


def register_chunks(spark: SparkSession, name: str = "chunks", config: Chunking = Chunking()) -> None:
    class Chunks:
        def eval(self, content: str, source: str, path: str) -> Iterator[tuple]:
            yield from chunks_of(content, source, path, config)

    spark.udtf.register(name, F.udtf(Chunks, returnType=ROWS))


def register_embed(spark: SparkSession, model: Model, folder: str | None = None, name: str = "embed") -> Callable:
    """A function text -> vector of a model: by its files, or by hashed words if no folder is given."""
    from .vectors import hash_embedder

    if folder is None:
        return spark.udf.register(name, hash_embedder(model.dimension, model.normalize))
    made = embedder(model, spark, folder)
    return spark.udf.register(name, made)
