"""Documents to chunks: sections by headings or code boundaries, windows of bounded length.

One row becomes many by a generator over an array that expressions build; nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import blocks, let, running
from ..functions.text import chunk_id, classify_kind, content_hash, detect_language, line_breaks, trim_space

# Lines at which code of a language is cut, first match wins; group 1 is the name.
_JS = (r"^(?:async\s+)?function\s+(\w+)\s*\(", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)", r"^class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{")
BOUNDARIES = {
    "go": (r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"^type\s+(\w+)\s+(?:struct|interface|func|map|chan|\[)"),
    "py": (r"^(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*:", r"^class\s+(\w+)\s*(?:\([^)]*\))?\s*:"),
    "js": _JS,
    "ts": (*_JS, r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    "rs": (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*\(", r"^(?:pub\s+)?(?:struct|enum|trait|impl)\s+(?:<[^>]+>\s+)?(\w+)"),
}
#: Characters of a text from which on windows are cut out of its form in UTF-32.
LONG = 1 << 16
_MARK = "struct<offset:int,name:string,level:int,line:int>"


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 2200
    overlap_chars: int = 300
    min_chars: int = 400
    respect_headings: bool = True


def windows(start: Column, end: Column, max_chars: int, overlap: int) -> Column:
    """Offsets [s, e) that cover start to end: one if it fits, else steps of max_chars less overlap."""
    step = max_chars - overlap if max_chars > overlap else max_chars
    n = end - start
    count = F.when(n <= max_chars, 1).otherwise(1 + F.ceil((n - max_chars) / step)).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((start + i * step).cast("int").alias("s"), F.least(start + i * step + max_chars, end).cast("int").alias("e"), (i == 0).alias("first")))
    return F.when((n > 0) & F.lit(max_chars > 0), each).otherwise(F.array().cast("array<struct<s:int,e:int,first:boolean>>"))


def marks(content: Column, of_line) -> Column:
    """Array of (offset, name, level, line) for the lines on which ``of_line`` gives (matches, name, level).

    Lines are folded block by block, so what a fold has found is copied for its block's marks only.
    """
    none = F.array().cast(f"array<{_MARK}>")

    def step(state: Column, line: Column) -> Column:
        matches, name, level = of_line(line["text"])
        mark = F.struct(state["at"].alias("offset"), name.alias("name"), level.cast("int").alias("level"), state["line"].alias("line"))
        return F.struct((state["at"] + line["size"]).alias("at"), (state["line"] + 1).alias("line"), F.when(matches, F.concat(state["found"], F.array(mark))).otherwise(state["found"]).alias("found"))

    def of_block(lines: Column) -> Column:
        return F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), none.alias("found")), step)

    def joined(parts: Column) -> Column:
        at, line = (let(running(F.transform(parts, lambda p: p[c].cast("long"))), lambda x: F.transform(x, lambda n: n.cast("int"))) for c in ("at", "line"))
        starts = F.zip_with(at, line, lambda a, n: F.struct(a.alias("at"), (n + 1).alias("line")))
        move = lambda s: lambda m: F.struct((m["offset"] + s["at"]).alias("offset"), m["name"].alias("name"), m["level"].alias("level"), (m["line"] + s["line"]).alias("line"))
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["found"], move(s))))

    # trimmed once, before what is asked of a line
    lines = F.transform(F.split(content, "\n", -1), lambda x: F.struct(trim_space(x).alias("text"), (F.length(x) + 1).alias("size")))
    return let(lines, lambda x: let(F.transform(blocks(x), of_block), joined))


def headings(content: Column) -> Column:
    """Lines that, trimmed, start with one to six number signs and go on with something else."""

    def of_line(t: Column):
        name = trim_space(F.regexp_replace(t, "^#+", ""))
        return t.startswith("#") & t.rlike("^#{1,6}[^#]") & (name != ""), name, F.length(F.regexp_extract(t, "^(#+)", 1))

    return marks(content, of_line)


def code_boundaries(content: Column, ext: Column) -> Column:
    """Lines at which a function, type or class begins, by the language's patterns."""

    def of_line(t: Column):
        matches, name = F.lit(False), F.lit("")
        for language, patterns in BOUNDARIES.items():
            own = F.lit("")
            for p in reversed(patterns):
                own = F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(own)
            matches = F.when(ext == language, t.rlike("|".join(f"(?:{p})" for p in patterns))).otherwise(matches)
            name = F.when(ext == language, own).otherwise(name)
        return matches, name, F.lit(0)

    return F.when(ext.isin(*BOUNDARIES), marks(content, of_line)).otherwise(F.array().cast(f"array<{_MARK}>"))


def build_chunks(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Chunks of documents (source_name, abs_path, rel_path, extension, content, byte_size)."""
    content, ext = F.col("content"), F.col("extension")
    base = docs.select("source_name", F.col("abs_path").alias("file_path"), "rel_path", "extension", "content", "byte_size")
    base = base.filter(F.length("content") > 0).withColumns({"kind": classify_kind(ext), "language": detect_language(ext), "content_hash": content_hash(content), "_n": F.length(content)})
    none = F.array().cast(f"array<{_MARK}>")
    base = base.withColumn("_heads", F.when(F.col("kind") == "markdown", headings(content)).otherwise(none))
    base = base.withColumn("_marks", F.when(F.col("kind") == "code", code_boundaries(content, ext)).when(F.lit(config.respect_headings), F.col("_heads")).otherwise(none))
    some = F.size("_marks") > 0
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.lit("").alias("name"), F.lit(0).alias("level"), F.lit(1).alias("line")))
    # what stands before the first boundary of code is a section; before the first heading it is lost
    lead = F.when(some & (F.col("kind") == "code") & (F.col("_marks")[0]["offset"] > 0), whole).otherwise(none)
    # characters of a long text are found by their place where each has four bytes, not by counting from its start
    wide = F.when(F.col("_n") > LONG, F.encode(content, "UTF-32"))
    base = base.withColumn("_sections", F.when(some, F.concat(lead, F.col("_marks"))).otherwise(whole))
    sections = F.col("_sections")

    step = config.max_chars - config.overlap_chars if config.max_chars > config.overlap_chars else config.max_chars

    def cut(mark: Column, i: Column, wide: Column) -> Column:
        """A section's windows with their text and the line breaks in it, and in what the next window doesn't repeat."""
        end = F.coalesce(F.get(sections, i + 1)["offset"], F.col("_n"))

        def window(w: Column) -> Column:
            far = F.decode(F.substring(wide, 4 * w["s"] + 1, 4 * (w["e"] - w["s"])), "UTF-32")
            raw = F.when(wide.isNotNull(), far).otherwise(F.substring(content, w["s"] + 1, w["e"] - w["s"]))
            return F.struct(raw.alias("raw"), F.when(w["first"], mark["name"]).otherwise("").alias("name"), F.when(w["first"], mark["level"]).otherwise(0).alias("level"), mark["line"].alias("line"))

        # one step after another, so that no text is cut out twice
        cuts = F.transform(windows(mark["offset"], end, config.max_chars, config.overlap_chars), window)
        return F.transform(cuts, lambda w: F.struct(w["raw"].alias("raw"), w["name"].alias("name"), w["level"].alias("level"), w["line"].alias("line"), line_breaks(w["raw"]).alias("breaks"), line_breaks(F.substring(w["raw"], 1, step)).alias("own")))

    def numbered(section: Column) -> Column:
        """Windows with trimmed text, first and last line: a section's lines are counted from its mark's, each character once."""

        def window(w: Column, before: Column) -> Column:
            return F.struct(trim_space(w["raw"]).alias("body"), w["name"].alias("name"), w["level"].alias("level"), (w["line"] + before).cast("long").alias("line"), w["breaks"].alias("breaks"))

        return F.zip_with(section, running(F.transform(section, lambda w: w["own"].cast("long"))), window)

    base = base.withColumn("_cut", let(wide, lambda x: F.transform(sections, lambda mark, i: cut(mark, i, x))))
    base = base.withColumn("_windows", F.flatten(F.transform("_cut", numbered)))
    count = F.size("_windows")
    record = F.transform("_windows", lambda w, i: F.struct(i.cast("long").alias("index"), *[w[c].alias(c) for c in ("body", "name", "level", "line")], (w["line"] + w["breaks"]).alias("end_line")))
    base = base.withColumn("_kept", F.filter(record, lambda r: (r["body"] != "") & ((F.length(r["body"]) >= config.min_chars) | (r["index"] == count - 1) | (count <= 1))))
    alone = F.struct(F.lit(0).cast("long").alias("index"), trim_space(content).alias("body"), F.lit("").alias("name"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("line"), (1 + line_breaks(content)).cast("long").alias("end_line"))
    base = base.withColumn("_some", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.array(alone)))
    # texts, headings and windows stay behind: a chunk takes only its own along; no array is empty, and the
    # outer form keeps the optimizer from computing all of them once more to filter empty ones out
    markdown = F.col("kind") == "markdown"
    first = F.coalesce(F.get(F.col("_heads"), F.lit(0))["name"], F.lit("")).alias("_first")
    listed = F.when(F.size("_heads") > 0, F.to_json(F.transform("_heads", lambda h: h["name"]))).otherwise("").alias("headings_json")
    rows = base.select("source_name", "file_path", "rel_path", "extension", "byte_size", "kind", "language", "content_hash", first, listed, F.explode_outer("_some").alias("c"))
    return rows.select(
        chunk_id(F.col("source_name"), F.col("rel_path"), F.col("c.index"), F.col("content_hash")).alias("id"), "source_name", "file_path", "rel_path", F.col("c.body").alias("content"),
        F.col("c.line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.index").alias("chunk_index"), "kind", "extension", "language",
        F.when((F.col("c.name") != "") & markdown, F.col("c.name")).otherwise(F.col("_first")).alias("title"), "headings_json", F.col("byte_size").cast("long").alias("byte_size"), "content_hash", F.current_timestamp().alias("created_at"),
        F.when(F.col("kind") == "code", F.col("c.name")).otherwise("").alias("function_name"), F.when(markdown, F.col("c.level")).otherwise(0).cast("long").alias("section_level"),
    )
