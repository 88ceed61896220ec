"""Personal data: patterns by rule, and what their contexts lead to.

The base rules find e-mail addresses, IP addresses, card numbers and phone numbers by form.
They are seeds.  Things of looser form (an address written with "(at)", a phone number without its
country, a number of a card's length that fails the checksum, an IPv6 address) are candidates: their form alone proves
nothing.  Seeds induce lexical patterns, the words just before or just after them, and a
graph joins patterns with the instances that stand in them.  It is scored in rounds:

* a pattern's confidence is the share of its occurrences in all texts, whatever stands there, that are known
  identifiers of one kind, each weighted with its own confidence; a pattern needs MIN_KNOWN
  different known identifiers, so copies of one document prove nothing;
* a candidate is as sure as its patterns together (noisy or); from MIN_INSTANCE on it
  is known itself, and the next round's patterns may build on it.

Rounds end when nothing new is known, ROUNDS at most.  A candidate whose form is that of a known identifier
("a (at) b.c" for a@b.c) is known from the start.  All mentions of an identifier found in this way are
spans of its document, besides those of the base rules, which stay.

Patterns that a common word makes have a confidence near zero, since everything that follows it counts.  Occurrences
are counted over whole texts for the patterns that have MIN_KNOWN instances; filters of BITS bits
tell executors which these and their words are, and those that slip through are joined away.

Defined results: a null text is empty; empty texts have no spans; texts of any length are read whole, in time
linear in their length; repeated rows are judged alike and each keeps its row; a null id is carried like any other;
an empty table gives an empty result; only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import freed, small_batches, staged

KINDS = ("email", "ip", "card", "phone")
#: Different known identifiers that a pattern needs; confidences from which a pattern and a candidate count; rounds at most.
MIN_KNOWN, MIN_PATTERN, MIN_INSTANCE, ROUNDS = 3, 0.5, 0.5, 5
#: Words of context that are read on each side of a mention: no more characters than this.
CONTEXT = 80
#: Bits of the filter that executors get.
BITS = 1 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_ZEROS = str.maketrans("123456789", "000000000")
#: Candidates: looser forms of each kind.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[(\[](?:at|AT)[)\]] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]{1,63}){0,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Fa-f:.])"),
    "digits": re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"),
}
_NEEDED = {"email": ("@", "(at", "(AT", "[at", "[AT"), "ip": (":",)}
_WORD = re.compile(r"\w+|[^\w\s]")
_SHARED = re.compile(r"[^\W_]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A name's characters before an @, as many as there are, and a domain after it; every character is looked at once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four parts of a run of numbers between dots, if none is over 255."""
    out = []
    for run in _NUMBERS.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"email": emails(text) if "@" in text else [], "ip": addresses(text), "card": cards(text), "phone": phones(text) if "+" in text else []}


def named(kind: str, found: str) -> str:
    """An identifier however it is written."""
    if kind == "email":
        found = re.sub(r" ?[(\[]at[)\]] ?", "@", found.lower())
        return re.sub(r" ?[(\[]dot[)\]] ?", ".", found)
    return found.lower() if kind == "ip" else "".join(_DIGITS.findall(found))


def loose_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that touch no span of the base rules: kind, start, end."""
    out = []
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, pattern in _LOOSE.items():
        if kind != "digits" and not any(c in text for c in _NEEDED[kind]):
            continue
        for m in pattern.finditer(text):
            low, high = m.span()
            if kind == "ip" and m[0].count("::") != 1 and m[0].count(":") != 7:
                continue  # a time of day, say
            at = bisect_left(starts, high)
            if not at or ends[at - 1] <= low:
                n = len(_DIGITS.findall(m[0])) if kind == "digits" else 0
                for own in [kind] if kind != "digits" else [*["phone"] * (n <= 15), *["card"] * (n >= 13)]:
                    out.append((own, low, high))
    return out


def words(text: str) -> list[str]:
    """Words and single marks, in lower case, every digit as 0."""
    return _WORD.findall(text.lower().translate(_ZEROS))


def patterns(text: str, low: int, high: int) -> list[str]:
    """What stands before and after a span: the last word, the last two, the next two, those that have a letter or digit."""
    before = text[max(0, low - CONTEXT) : low]
    if low > CONTEXT:  # a word that is cut off is none
        before = before.lstrip().partition(" ")[2] if not before[0].isspace() else before
    after = text[high : high + CONTEXT]
    left, right = words(before)[-2:], words(after)[:2]
    out = [f"L {left[-1]}"] if left else []
    out += [f"L {' '.join(left)}"] if len(left) == 2 else []
    out += [f"R {' '.join(right)}"] if len(right) == 2 else []
    return [p for p in out if _SHARED.search(p[2:])]


def mentions(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple]]:
    """Spans of the base rules, and all mentions: kind, identifier, whether it is a seed, start, end, patterns."""
    base = base_spans(text)
    taken = [s for spans in base.values() for s in spans]
    out = [(k, named(k, text[a:b]), True, a, b, patterns(text, a, b)) for k, spans in base.items() for a, b in spans]
    return base, out + [(k, named(k, text[a:b]), False, a, b, patterns(text, a, b)) for k, a, b in loose_spans(text, taken)]


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def bit(pattern: str) -> int:
    return zlib.crc32(pattern.encode()) % BITS


class Numbers(dict):
    """Words by number, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def occurring(texts: list[str], wanted: np.ndarray) -> Iterator[tuple[str, int]]:
    """Contexts of some texts and how often each stands there: a word before anything, two before anything, two after anything.

    ``wanted``: flags by ``bit`` of the words that count.
    """
    numbers = Numbers()
    coded = [np.fromiter(map(numbers.__getitem__, words(t)), np.int64) for t in texts]
    coded = [c for c in coded if len(c) > 1]
    if not coded:
        return
    listed_, flat = list(numbers), np.concatenate(coded)
    flags = np.array([wanted[bit(w)] for w in listed_])[flat]
    ends = np.cumsum([len(c) for c in coded])
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[ends - [len(c) for c in coded]] = last[ends - 1] = True
    one, n = np.unique(flat[flags & ~last], return_counts=True)
    yield from ((f"L {listed_[a]}", k) for a, k in zip(one.tolist(), n.tolist()))
    pair = np.flatnonzero(flags[:-1] & flags[1:] & ~last[:-1])
    for side, some in (("L", pair[~last[pair + 1]]), ("R", pair[~first[pair]])):
        both, n = np.unique(flat[some] * len(listed_) + flat[some + 1], return_counts=True)
        yield from ((f"{side} {listed_[x // len(listed_)]} {listed_[x % len(listed_)]}", k) for x, k in zip(both.tolist(), n.tolist()))


_MENTION = pa.struct([("kind", pa.string()), ("name", pa.string()), ("seed", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("patterns", pa.list_(pa.string()))])
_NAMES = ("kind", "name", "seed", "low", "high", "patterns")
_TYPES = (StringType(), StringType(), BooleanType(), LongType(), LongType(), ArrayType(StringType()))
_MENTIONS = ArrayType(StructType([StructField(n, t) for n, t in zip(_NAMES, _TYPES)]))


def found_by_rule(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The carried columns as c0, c1, ..., then counts, base and mentions of every row."""
    names = [f"c{i}" for i in range(len(carry))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col(f"`{text}`").cast("string").alias("text"))
    made = StructType([*source.schema.fields[:-1], *[StructField(k, LongType()) for k in KINDS], StructField("base", StringType()), StructField("mentions", _MENTIONS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [mentions(t or "") for t in b["text"].to_pylist()]
            counts = [pa.array([len(base[k]) for base, _ in each], pa.int64()) for k in KINDS]
            whole = pa.array([[dict(zip(_NAMES, m)) for m in ms] for _, ms in each], pa.list_(_MENTION))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts, pa.array([listed(base) for base, _ in each], pa.string()), whole], made.names)

    return source.mapInArrow(run, made)


def flagged(texts: DataFrame) -> np.ndarray:
    """Flags by ``bit`` of the strings in the only column: BITS / 64 rows at most come to the driver."""
    each = texts.select(F.pmod(F.crc32(F.col(texts.columns[0]).cast("binary")), F.lit(BITS)).alias("bit"))
    rows = each.groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def counted(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """pattern, occurrences: how often each wanted pattern's context stands in the texts."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((flagged(wanted), flagged(wanted.select(F.explode(F.split(F.substring("pattern", 3, 1 << 30), " "))))))  # BITS / 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_patterns, of_words = [np.unpackbits(x.view(np.uint8), bitorder="little").astype(bool) for x in held.value]
        for b in batches:
            kept = [(p, n) for p, n in occurring([t or "" for t in b.column(0).to_pylist()], of_words) if of_patterns[bit(p)]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["pattern", "n"])

    sums = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("occurrences"))
    return wanted.select("pattern").distinct().join(sums, "pattern")


def bootstrapped(edges: DataFrame, occurrences: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, name of the candidates that patterns lead to.

    edges: kind, name, pattern, n (mentions in it); occurrences: pattern, occurrences; seeds: kind, name.
    """
    edges = edges.join(occurrences, "pattern")
    known = seeds.withColumn("sure", F.lit(1.0))
    before = known.count()
    for turn in range(ROUNDS):
        of_pattern = edges.join(known, ["kind", "name"]).groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("different"), F.sum(F.col("n") * F.col("sure")).alias("weight"), F.max("occurrences").alias("occurrences"))
        share = F.least(F.col("weight") / F.greatest("occurrences", "weight"), F.lit(0.99)).alias("share")
        trusted = of_pattern.filter(F.col("different") >= MIN_KNOWN).select("kind", "pattern", share).filter(F.col("share") >= MIN_PATTERN)
        sure = (1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("sure")
        new = edges.join(known.select("kind", "name"), ["kind", "name"], "left_anti").join(trusted, ["kind", "pattern"]).groupBy("kind", "name").agg(sure).filter(F.col("sure") >= MIN_INSTANCE)
        grown = staged(known.unionByName(new), "pii-known")
        if turn:
            freed(known)
        known, after = grown, grown.count()
        if after == before:
            break
        before = after
    return known.select("kind", "name")


def personal_data(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_email, n_ip, n_card, n_phone and base (spans of the base rules), spans (all), n_added.

    Spans are written kind:start:end, in code points, the end exclusive, by kind and then start.
    """
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    rows = staged(found_by_rule(docs, text, list(carry)).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.select("kind", "name", F.explode("patterns").alias("pattern")).groupBy("kind", "name", "pattern").agg(F.count(F.lit(1)).alias("n"))
    edges = staged(edges, "pii-edges")
    seeds = staged(each.filter("seed").select("kind", "name").distinct(), "pii-seeds")
    loose = each.filter("not seed")
    # only patterns in which a candidate stands can lead anywhere
    asked = edges.join(loose.select("kind", "name").distinct(), ["kind", "name"], "left_semi").select("kind", "pattern").distinct()
    wanted = edges.join(asked, ["kind", "pattern"], "left_semi").groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") >= MIN_KNOWN)
    wanted = staged(wanted.select("pattern"), "pii-wanted")
    occurrences = staged(counted(docs, text, wanted), "pii-occurrences")
    known = bootstrapped(edges, occurrences, seeds)
    freed(edges, seeds, wanted, occurrences)
    added = loose.join(known, ["kind", "name"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("kind", "low", "high")).alias("added"))
    joined = rows.join(added, "row", "left")
    place = F.array(*[F.lit(k) for k in KINDS])
    split = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    ruled = F.transform(split, lambda s: F.struct(F.array_position(place, s[0]).alias("k"), s[1].cast("long").alias("low"), s[2].cast("long").alias("high")))
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<kind:string,low:long,high:long>>")), lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["low"].alias("low"), s["high"].alias("high")))
    both = F.array_join(F.transform(F.array_sort(F.concat(ruled, more)), lambda s: F.concat_ws(":", F.get(place, (s["k"] - 1).cast("int")), s["low"], s["high"])), ",")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(both)
    return joined.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], *[F.col(k).alias(f"n_{k}") for k in KINDS], "base", spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
