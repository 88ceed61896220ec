"""Results for people and programs."""

from __future__ import annotations

import json
import re

ON, OFF = "\033[1;33m", "\033[0m"


def merged_ranges(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Ranges within 0 to size, in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] < r[1] <= size and r[0] < size):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def highlight(text: str, ranges: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for low, high in merged_ranges(ranges, len(text)):
        parts += [text[at:low], ON, text[low:high], OFF]
        at = high
    return "".join([*parts, text[at:]])


def clean(text: str, ranges: list[tuple[int, int]] = []) -> tuple[str, list[tuple[int, int]]]:
    """Text with white space as single blanks, cut to 180 characters, and the ranges as they then lie."""
    out, to = "", []
    for c in text:
        to.append(len(out))
        if not c.isspace():
            out += c
        elif out and not out.endswith(" "):
            out += " "
    to.append(len(out))
    cut = out.rstrip(" ")
    cut = cut if len(cut) <= 180 else cut[:177] + "..."
    most = min(len(cut), 177 if len(out.rstrip(" ")) > 180 else len(cut))
    return cut, [(to[low], min(to[high], most)) for low, high in ranges if 0 <= low < high < len(to) and to[low] < most]


def as_json(response: dict) -> str:
    shown = response | {"results": [{k: v for k, v in r.items() if k != "matched_terms"} for r in response["results"]]}
    return json.dumps(shown, indent=2, ensure_ascii=False, default=str)


def quoted(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of a text as they lie in its quoted form."""
    at = lambda n: len(json.dumps(text[:n], ensure_ascii=False)) - 1
    return [(at(low), at(high)) for low, high in ranges]


def as_text(response: dict) -> str:
    if not response["results"]:
        return "No results found."
    lines = []
    for i, r in enumerate(response["results"], 1):
        m = r["metadata"]
        snippet, marked = clean(r["snippet"], r.get("matched_terms") or [])
        lines += [f"{i}. {r['file_path']}", f"   {highlight(json.dumps(snippet, ensure_ascii=False), quoted(snippet, marked))}", f"   score: {r['score']:.4f} | source: {r['source_name']} | lines: {m['start_line']}-{m['end_line']}"]
        lines += [f"   title: {m['title']}"] if m["title"] else []
        lines.append("")
    return "\n".join(lines)


def format_size(n: int) -> str:
    """Whole bytes, kilobytes and megabytes; gigabytes to a tenth."""
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        if n < 1024 ** (power + 1) or unit == "GB":
            return f"{n}B" if n < 1024 else f"{n / 1024**power:.{1 if unit == 'GB' else 0}f}{unit}"
    raise AssertionError


def status_text(status: dict) -> str:
    lines = [f"Bundle: {status['bundle']}", f"Indexed: {status['indexed_at']}", f"Model: {status['mode']} ({status['model']})", f"Sources: {len(status['sources'])}"]
    lines += [f"  {name:<20} {files} files" for name, files in status["sources"]]
    lines += [f"Total: {status['files']} files, {status['chunks']} chunks, {status['embeddings']} embeddings", "", f"State: {status['state']}"]
    return "\n".join(lines)
