"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds and languages by extension.
KINDS = {
    "markdown": ("md", "markdown"),
    "code": ("go", "rs", "ts", "tsx", "js", "jsx", "py", "java", "c", "cc", "cpp", "h", "hpp", "sh", "bash", "zsh", "json", "toml", "yaml", "yml"),
    "text": ("txt", "text", "rst", "canvas"),
}
LANGUAGES = {"go": "go", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "sh": "shell", "bash": "shell", "zsh": "shell", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown"}


# The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends; reads no more than the ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_ext(name: Column) -> Column:
    """Extension of a file name: lower case, without dot; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def classify_kind(ext: Column) -> Column:
    kind = F.lit("unknown")
    for name, extensions in KINDS.items():
        kind = F.when(ext.isin(*extensions), name).otherwise(kind)
    return kind


def detect_language(ext: Column, extra: dict[str, str] | None = None) -> Column:
    """Language of an extension, empty if it has none."""
    table = LANGUAGES | (extra or {})
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[ext], F.lit(""))


def _path_ext(path: Column) -> Column:
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit(""))


def kind_of_path(path: Column) -> Column:
    return classify_kind(_path_ext(path))


def language_of_path(path: Column) -> Column:
    return detect_language(_path_ext(path), {"markdown": "markdown"})


def content_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def chunk_id(source: Column, rel_path: Column, index: Column, digest: Column) -> Column:
    return F.sha1(F.concat_ws("|", source, rel_path, index.cast("string"), digest).cast("binary"))


def chunking_hash(max_chars: int, overlap: int, min_chars: int, headings: bool) -> str:
    import hashlib

    return hashlib.sha1(f"{max_chars}|{overlap}|{min_chars}|{str(headings).lower()}".encode()).hexdigest()


def chunking_hash_of(max_chars: Column, overlap: Column, min_chars: Column, headings: Column) -> Column:
    """``chunking_hash`` of columns."""
    return F.sha1(F.concat_ws("|", *[c.cast("string") for c in (max_chars, overlap, min_chars, headings)]).cast("binary"))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` code points; a cut shows as three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column) -> Column:
    return shortened(text, 220)


def clean_snippet(text: Column) -> Column:
    return shortened(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 180)


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
