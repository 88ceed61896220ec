import hashlib
import os
import random
import re
import struct
import textwrap
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import ann, bpe, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup, url_filters, warc, wordsplit
from gleaner.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY

LONG = "word " * 40_000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "Ünïcödé 日本語 text <|endoftext|> here"), (6, LONG), (7, LONG), (None, "no id at all, but words enough to be a text"), (None, None), (8, "x" * 5000), (9, "a b c d e f g h"), (10, "a b c d e f g h")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("id", "row", "node", "n", "shard", "rank", "length", "key", "spans", "kept", "score")])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(name, spark, sf):
    assert oracle.differences(QUERIES[name], ORACLE_SQL[name], spark, sf, oracle.database(sf)) == ""


# -- nearest neighbours ------------------------------------------------------


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = [(sum_in_order(v, w), -i) for i, w in rows if i != q and len(w) == len(v)]
        out[q] = [(-i, s) for s, i in sorted(scored, reverse=True)[:k]]
    return out


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def test_nearest_with_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 10 ** rng.randint(-3, 3)) for _ in range(8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 330)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] * 8), (904, [None] * 8), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows + odd[-1:], [r for r in rows if r[0] % 20 == 0], 7)
    found = defaultdict(list)
    for r in got:
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(found) == want
    assert ann.nearest(df.filter("false"), df.filter("false")).count() == 0


def test_blocks_and_bounds_lose_nothing(spark, monkeypatch):
    for name, n in {"QUERY_VALUES": 16, "BLOCK_VALUES": 64, "ROWS": 3, "TILE": 5, "PAIRS": 2}.items():
        monkeypatch.setattr(ann, name, n)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 10 = 0"), 5).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, n, v) for q, x in want.items() for n, (v, _) in enumerate(x, 1)}


def test_repeated_vectors_and_clashing_names(spark):
    """A vector that most rows share, ids that come again, and columns with the names used inside."""
    rng = random.Random(14)
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(0, 200)] + [(7, hot)] * 30 + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200, 260)] + [(20, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "dim", "block", "query_block", "score", "rank")])
    got = ann.nearest(df, df.filter("vec_id in (0, 7, 21, 220, 240)"), 6).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] in (0, 7, 21, 220, 240)], 6)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(found) == want


# -- URL filters ---------------------------------------------------------------


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://A.Example.NET/en/x?q", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        ("https://example.net/de/", ("example.net", "/de/", "net/", "block")),
        ("http://notexample.com/de/", ("notexample.com", "/de/", None, None)),
        ("http://x.org/fr/#a", ("x.org", "/fr/", "org/fr/", "allow")),
        ("http://x.org?fr/", ("x.org", "", None, None)),
        ("no scheme", ("", "", None, None)),
        (None, ("", "", None, None)),
        ("a://b://c/d", ("b:", "//c/d", None, None)),
    ],
)
def test_hosts_and_rules(spark, url, want):
    host, path = url_filters.host_of(F.col("u")), url_filters.path_of(F.col("u"))
    df = spark.createDataFrame([(url,)], "u string").select(host.alias("h"), path.alias("p"))
    rule, verdict = url_filters.rule_columns(F.col("h"), F.col("p"))
    assert tuple(df.select("h", "p", rule, verdict).first()) == want


def test_urls_without_labels_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "http://x.example/a"), (3, "http://é\n☃.de/" + "y" * 9000)], "page_id long, url string").withColumn("score", F.lit(1)).withColumn("host", F.lit(2))
    got = url_filters.judge_urls(df).collect()
    assert len(got) == 5 and {r["verdict"] for r in got} == {"allow"}
    assert url_filters.judge_urls(df.filter("false")).count() == 0


# -- near duplicates -----------------------------------------------------------


def brute_classes(texts):
    words = [[w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    links, parent = [0] * len(texts), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return links, [top(x) for x in range(len(texts))]


def test_classes_of_copies_and_edits(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "CANDIDATE_BLOCK", 16)
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 999)}" for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(25):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(edited))
    texts += [texts[0]] * 3 + [None, "", "a b", "a b", "a  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_classes(df).collect()}
    links, tops = brute_classes(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == tops
    stay = {r["doc_id"] for r in ngram_join.one_of_each(df).collect()}
    assert stay == set(tops)


def test_classes_of_odd_rows(odd, empty):
    got = ngram_join.jaccard_classes(odd).collect()
    assert len(got) == len(TEXTS)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert by[6] == by[7] == {(6, 1)} and by[4] == {(4, 1)} and by[1] == {(1, 0)} and by[10] == {(9, 1)}
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect())[4] == 1


def thue_morse(n):
    return ["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n)) for flip in (0, 1)]


def test_words_that_collide_under_polynomial_hashes_are_not_linked(spark):
    """Opposite Thue-Morse words of 1024 characters have equal polynomial hashes modulo 2**64 for any base."""
    texts = [*thue_morse(1024), *thue_morse(48), *[" ".join([x] * 7) for x in thue_morse(2048)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.jaccard_classes(df).collect()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(k, k, 0) for k in range(len(texts))}


def test_clashing_names_stay_as_they_are(spark):
    """Columns with the names that stages use inside."""
    rows = [(1, "one two three four five six", 7), (2, "one two three four five six", 8), (2, "one two three four five six", 8), (None, "", 9)]
    names = ["row", "__row", "__good", "name", "packed", "best", "kept", "sample", "c0", "missing", "spans", "n_bytes"]
    df = spark.createDataFrame(rows, "doc_id long, text string, v long").select("doc_id", "text", *[F.col("v").alias(c) for c in names])
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or 0, r["__row"], r["row"]) for r in got.collect()) == [(0, 9, 9), (1, 7, 7)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (lambda x: quality_classifier.keep_sampled(x, labels), quality_rules.keep_good, suffix_dedup.without_repeats):
        out = stage(df)
        assert out.columns == df.columns and all(len(set(list(r)[2:])) == 1 for r in out.collect())


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
        i, _ = ngram_join.survivors(*[ngram_join.minhash(x).astype(np.uint8)[None] for x in (a, b)], False)
        lost += not len(i)
    assert lost == 0


# -- packing -------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1), st.integers(60, 64))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_piece_once(histogram, capacity):
    runs = packing.plan_packing(histogram, capacity, 5)
    seen = defaultdict(list)
    for n, held in runs:
        assert n > 0 and sum(s for s, _ in held) <= capacity
        for s, first in held:
            seen[s] += range(first, first + n)
    assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(n)) for s, n in histogram.items()}


def test_plans_are_near_the_least():
    rng = random.Random(5)
    for draw, slack in ((lambda: rng.randint(1, 2048), 1.02), (lambda: min(2048, int(rng.lognormvariate(6.4, 1)) + 1), 1.005), (lambda: rng.randint(1, 300), 1.001)):
        sizes = Counter(draw() for _ in range(20_000))
        least = -(-sum(s * n for s, n in sizes.items()) // 2048)
        assert sum(n for n, _ in packing.plan_packing(dict(sizes))) <= slack * least + 1


def test_packed_rows(odd, empty):
    rows = packing.pack(odd, VOCABULARY, with_ids=True).collect()
    whole = bpe.vocabulary(VOCABULARY).whole
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in TEXTS)
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append(r)
    # repeated rows can't be told apart: of each id, all pieces and starts are those of its texts
    for i in {i for i, _ in TEXTS}:
        whole_pieces = Counter()
        for (j, ids), times in want.items():
            if j == i:
                first = len(ids) % 2048 or 2048
                bounds = [0, *range(first, len(ids) + 1, 2048)]
                for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
                    whole_pieces[k, low, ids[low:high]] += times
        assert Counter((r["piece"], r["start"], tuple(r["ids"])) for r in pieces[i]) == whole_pieces
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(empty, VOCABULARY).count() == 0


# -- BPE -----------------------------------------------------------------------


PATTERN = regex.compile(bpe.PATTERN)


@given(st.lists(st.text(max_size=12) | st.text(alphabet="ab '\n\t .1é_slrevmtd", max_size=12), max_size=5))
@settings(max_examples=400, deadline=None)
def test_words_of_batches_are_those_of_the_pattern(texts):
    v = bpe.vocabulary(VOCABULARY)
    data, start, end, n = v.spans(texts)
    words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    want = [[w for part in v.cut.split(t) for w in ([part] if part in v.special else PATTERN.findall(part)) if w] for t in texts]
    assert words == [w for t in want for w in t] and n.tolist() == [len(t) for t in want]
    which, first = wordsplit.distinct(data, start, end)
    assert [words[first[k]] for k in which] == words and [words[k] for k in first] == list(dict.fromkeys(words))


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(wordsplit, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"one two one a long word of some bytes one two", np.uint8)
    start, end = np.array([0, 4, 8, 12, 14, 38, 42]), np.array([3, 7, 11, 13, 37, 41, 45])
    which, first = wordsplit.distinct(data, start, end)
    assert which.tolist() == [0, 1, 0, 2, 3, 0, 1] and first.tolist() == [0, 1, 3, 4]


@given(st.text() | st.text(alphabet="ab '\n\t\r\x1c\x85\xa0²½٣é日<|endoftx>_.s", max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_whole_texts_do(text):
    v = bpe.vocabulary(VOCABULARY)
    assert v.split(text) == [w for part in v.cut.split(text) for w in ([part] if part in v.special else PATTERN.findall(part)) if w]
    whole, bpe.STRETCH = bpe.STRETCH, 4
    assert "".join(v.stretches(text)) == text and v.encode(text).tolist() == v.whole.encode(text, add_special_tokens=False).ids
    bpe.STRETCH = whole
    want = v.whole.encode(text, add_special_tokens=False).ids
    words = v.split(text)
    assert "".join(words) == text
    assert [i for ids in v.encode_words(words) for i in ids] == want == v.encode(text).tolist()


def test_encode_and_decode(odd, empty, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    whole = bpe.vocabulary(VOCABULARY).whole
    want = Counter()
    for i, t in TEXTS:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(odd, VOCABULARY).collect())) == want
    assert bpe.encode_decode(empty, VOCABULARY).count() == 0


def test_decode_by_join(spark):
    whole = bpe.vocabulary(VOCABULARY).whole
    texts = ["", "Ünï 日本 words", "a<|endoftext|>b"]
    rows = [(k, whole.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)]
    got = bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), VOCABULARY).orderBy("k").collect()
    assert [r["decoded"] for r in got] == texts


# -- suffix dedup --------------------------------------------------------------


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[k : k + length] for _, t in raw for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out[i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("limit, segment, collide", [(2000, 1 << 20, False), (4, 1 << 20, False), (2000, 500, False), (2000, 1 << 20, True)])
def test_repeats_are_exactly_those_of_brute_force(spark, monkeypatch, limit, segment, collide):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    if segment < 1000:
        import pyarrow as pa

        from gleaner.llm.textnp import flat

        texts = pa.array(["".join(random.Random(k).choice("ab") for _ in range(900)) for k in range(4)])
        whole = suffix_dedup.anchors(*flat(texts), 40, 8)
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        cut = suffix_dedup.anchors(*flat(texts), 40, 8)
        covered = lambda f: {(int(t), int(s) + k, int(a)) for t, p, s, n, a, _ in zip(*f) for k in range(int(n))}
        assert covered(whole) == covered(cut)
        return
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(5)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 20) : rng.randint(30, 60)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(4))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (7, rows[7][1]), (None, "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if collide:  # all hashes that sorting goes by are equal, in the workers too
        with_collisions(spark, df, rows)
        return
    got = suffix_dedup.remove_repeats(df, length=40, gram=8)
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows, 40)


def with_collisions(spark, df, rows):
    """Sorting with a hash that is the same for everything: buckets out of order are sorted by bytes."""
    rng = random.Random(12)
    contexts = sorted({bytes(rng.choice(b"ab") for _ in range(12)) + b"the shared middle" + bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)})
    rng.shuffle(contexts)
    group, align = np.zeros(len(contexts), np.int64), np.full(len(contexts), -12)
    want = suffix_dedup.repeated_strings(contexts, group, align, 24)
    counts = Counter((k, c[k : k + 24]) for c in contexts for k in range(len(c) - 23))
    assert all(m[k] == (counts[k, c[k : k + 24]] > 1) for c, m in zip(contexts, want) for k in range(len(m))) and any(m.any() for m in want)
    kept = suffix_dedup.span_hashes
    suffix_dedup.span_hashes = lambda prefix, start, end: np.zeros(np.broadcast(start, end).shape, np.uint64)
    try:
        got = suffix_dedup.repeated_strings(contexts, group, align, 24)
    finally:
        suffix_dedup.span_hashes = kept
    assert all((a == b).all() for a, b in zip(got, want))


@pytest.mark.parametrize("limit", [3, 2000])
def test_a_passage_of_all_documents(spark, monkeypatch, limit):
    """Common anchors: stretches are counted, halved and never rows for each string of each context."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, own(rng.randint(0, 60)) + passage[rng.choice([0, 0, 0, 7]) :] + own(rng.randint(0, 60))) for i in range(150)]
    rows += [(500 + i, rows[i][1][5:]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, split = [], suffix_dedup._split
    monkeypatch.setattr(suffix_dedup, "_split", lambda parts, *how: (made.append(parts.count()), made.append((out := split(parts, *how)).count()))[0] or out)
    got = suffix_dedup.remove_repeats(df, length=40, gram=8)
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows, 40)
    assert (limit == 2000) == (not made) and sum(made[1::2]) <= 10 * sum(made[::2])


def test_repeats_in_odd_rows(odd, empty):
    got = suffix_dedup.remove_repeats(odd)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in TEXTS)
    assert {r["n_removed"] for r in got.filter("doc_id in (6, 7)").collect()} == {len(LONG)}
    cut = suffix_dedup.without_repeats(odd, count="n")
    assert cut.columns == odd.columns and {r["doc_id"]: r["text"] for r in cut.collect()}[1] is None
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_merge_sort_of_suffixes():
    rng = random.Random(7)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    s = suffix_dedup.Suffixes(np.frombuffer(data, np.uint8))
    place = np.array(rng.sample(range(360), 200))
    bucket = np.sort(np.array([rng.randint(0, 5) for _ in place]))
    order = s.merge_sorted(place, np.full(200, 40), bucket)
    want = sorted(range(200), key=lambda i: (bucket[i], data[place[i] : place[i] + 40], i))
    assert [data[place[i] : place[i] + 40] for i in order] == [data[place[i] : place[i] + 40] for i in want]


# -- quality -------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    top = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")
    seen = labels.filter("doc_id % 3 <> 0")
    got = quality_classifier.resampled(docs, seen).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    share = {r["q"]: r["kept"] for r in got.groupBy(kind.alias("q")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share["clean"] > 0.98 and share["junk"] < 0.05


def brute_resampled(rows, good):
    """Weights, noise and the k largest, document by document; hashes of words are the operator's."""
    import math

    import pyarrow as pa

    n = quality_classifier.BUCKETS
    runs = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        h = [int(quality_classifier.features(pa.array([x]))[0][0]) for x in w]
        pairs = [int(quality_classifier.features(pa.array([f"{x} {y}"]))[0][2]) for x, y in zip(w, w[1:])]
        runs[i] = h + pairs
    held = lambda i: to_signed(xxhash.xxh64_intdigest(b"held out", xxhash.xxh64_intdigest(struct.pack("<q", i), 42))) % 4 == 0
    raw, target = Counter(), Counter()
    for i, x in runs.items():
        raw.update(x)
        if i in good and not held(i):
            target.update(x)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + 10) / (raw[b] * share + 10)) for b in raw}
    weight = {i: sum(ratio[b] for b in x) / math.sqrt(max(1, len(x))) for i, x in runs.items()}
    sample = {}
    for i, t in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        h = to_signed(xxhash.xxh64_intdigest(b"gumbel", xxhash.xxh64_intdigest(struct.pack("<q", i), h)))
        sample[i] = weight[i] / 0.2 - math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))
    known = sorted(weight[i] for i in good if i in weight and held(i))
    level = known[max(0, math.ceil(0.003 * len(known)) - 1)]
    k = sum(w >= level for w in weight.values())
    least = sorted(sample.values(), reverse=True)[k - 1]
    assert n == 1 << 18
    return {i: (weight[i], len(runs[i]), sample[i], sample[i] >= least) for i in runs}


def to_signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_weights_noise_and_draws_are_those_of_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice("abcdefghij" if i % 3 else "bcdefghijk") for _ in range(rng.randint(0, 80)))) for i in range(400)] + [(400, None), (401, "")]
    good = {i for i in range(402) if i % 3 and i % 2}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 402, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.resampled(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    want = brute_resampled(rows, good)
    assert all(abs(got[i]["log_weight"] - w) < 1e-9 and got[i]["n_features"] == n and abs(got[i]["sample"] - x) < 1e-6 and got[i]["kept"] == kept for i, (w, n, x, kept) in want.items())
    by_weight = sorted(want, key=lambda i: -want[i][0])[: sum(x[3] for x in want.values())]
    assert {i for i in want if want[i][3]} != set(by_weight)  # draws matter


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (6, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.resampled(odd, labels).count() == len(TEXTS)
    assert quality_classifier.resampled(odd, labels.filter("false")).filter("kept").count() == len(TEXTS)
    assert quality_classifier.resampled(empty, labels).count() == 0
    assert quality_classifier.keep_sampled(odd, labels).columns == odd.columns


def test_ids_that_are_broadcast_are_bounded(spark, monkeypatch):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij" if i % 2 else "hijklmnopq") for _ in range(60))) for i in range(600)], "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    sizes, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda x: (sizes.append(x.count()), broadcast(x))[1])
    for labelled in (20_000, 50):
        monkeypatch.setattr(quality_classifier, "LABELLED", labelled)
        got = quality_classifier.resampled(df, labels).groupBy(F.col("doc_id") % 2).agg(F.avg(F.col("kept").cast("int"))).collect()
        share = dict(map(tuple, got))
        assert share[1] > 0.95 and share[0] < 0.1
    assert sizes[0] > 200 and 20 < sizes[1] < 90


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 100) for _ in range(3000)] + [5.0] * 50
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 500, 1525, 1550, 3050, 9999):
        assert quality_classifier.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 3050) - 1]
    assert quality_classifier.kth_largest(df.select(F.lit(2.0).alias("x")), "x", 7) == 2.0


def test_rules_on_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert (got[1]["n_words"], got[2]["n_words"], got[3]["n_words"], got[4]["n_words"]) == (0, 0, 0, 2)
    assert got[6]["n_words"] == got[6]["n_repeat_words"] == 40_000 and got[6]["base_failed"] and not got[1]["kept"]
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.quality_rules(empty).count() == 0


def test_counts_compare_lines_and_words_as_they_are(spark):
    """Lines and words that collide under polynomial hashes are not equal."""
    a, b = thue_morse(1024)
    texts = [f"{a}\n{b}", f"{a}\n{a}\n \n\n{b}", f"{a} x y {b} x y {a} x y", "", " ", "a b c a b c", "a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {0: (0, 0, 2), 1: (1, 0, 3), 2: (0, 6, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 6, 1), 6: (0, 6, 1)}


def test_failed_lines_leave_the_texts_that_stay(spark):
    import corpus_pipeline

    words = iter(f"w{k}" for k in range(10_000))
    prose = [" ".join(next(words) for _ in range(30)) + "." for _ in range(4)]
    marked = "\n".join(["Home | About | Contact | Help", prose[0], "", prose[1], "we use cookies on this site"])
    plain = "\n\n".join(prose[2:]) + "\n"
    df = spark.createDataFrame([(1, marked, "en", len(marked)), (2, plain, "en", len(plain)), (3, "too short", "en", 9), (4, None, "en", None)], "doc_id long, text string, kept string, n_chars int")
    got = corpus_pipeline.rules(spark, df, "")
    left = "\n".join([prose[0], "", prose[1]])
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [(1, left, "en", len(left)), (2, plain, "en", len(plain))]


def brute_failing(lines):
    """Which lines of a text fail, rule by rule, character by character."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines]
    out = []
    for i, (line, w) in enumerate(zip(lines, words)):
        n, last = len(w), i + 1 == len(lines) or not words[i + 1]
        bars = sum(c in "|>»·•" for c in line)
        pieces = re.findall(r"(?:[^\W_]|['’])+", line.lower())
        taken = [False] * len(pieces)
        for phrase in quality_rules.BOILERPLATE:
            p = phrase.split()
            for k in range(len(pieces) - len(p) + 1):
                if pieces[k : k + len(p)] == p and not any(taken[k : k + len(p)]):
                    taken[k : k + len(p)] = [True] * len(p)
        end = w[-1][-1] if w else ""
        closed = bool(w) and unicodedata.category(end) in ("Po", "Pe", "Pf", "Pi") and end not in "#*%&/\\@·•"
        out.append(n > 0 and (
            bars >= 3 and 3 * bars >= n or n >= 4 and (4 * sum(c in "#*$%&|<>" for c in line) > n or 2 * line.count("!!") > n)
            or sum(taken) > 0 and 2 * sum(taken) >= len(pieces) or n > 12 and last and not closed
        ))
    return out


LONG_LINE = " ".join(["word"] * 13)
PROSE = "The river ran on past the mill and the old men who sat there every evening spoke of nothing but rain and of the harvest that would not come this year, nor the next, if the priest was right about the comet and its long pale tail above the hills"


@pytest.mark.parametrize("line, fails", [("A plain sentence with an end.", False), ("Home | About | Contact | Help", True), ("!! no", False), ("AAA!! BBB!! CCC!! DDD!!", True), ("we use cookies on this site", True), ("A title", False), ("a# b$ c% d&", True), (LONG_LINE, True), (LONG_LINE + "!\r", False), (" ".join(["word"] * 12), False), ("Alle Rechte vorbehalten", True), ("Cliquez ici", True), ("Política de privacidad", True), ("one\u00a0two\x85three", False),
    ("The design in this old house is plain.", False), ("It was found in the catalog in March.", False), ("She baked a cookie.", False), ("Please sign in", True), ("Sign-in", True), ("Das Impressum fehlt auf dieser Seite leider ganz.", False), ("Impressum", True), (LONG_LINE + "。", False), (LONG_LINE + "！", False), (LONG_LINE + "？", False), (LONG_LINE + "۔", False), (LONG_LINE + "।", False), (LONG_LINE + " “so”", False), (LONG_LINE + " #", True), (LONG_LINE + "\nand on it goes.", False), (LONG_LINE + "\n \nAnother paragraph.", True)])
def test_line_rules(spark, line, fails):
    lines = line.split("\n")
    assert brute_failing(lines)[0] == fails
    cleaned = quality_rules.judge(pa.array([line]), quality_rules.Words())[-1].to_pylist()[0]
    assert cleaned == "\n".join(x for x, f in zip(lines, brute_failing(lines)) if not f)


@pytest.mark.parametrize("width", [40, 72, 90])
def test_wrapped_prose_stays(width):
    text = "\n\n".join("\n".join(textwrap.wrap(f"{PROSE}, {i} times over.", width)) for i in range(4))
    found = dict(zip([*quality_rules.COUNTS, "base_failed", "kept", "cleaned"], [x[0].as_py() for x in quality_rules.judge(pa.array([text]), quality_rules.Words())]))
    assert found["n_failed_lines"] == 0 and found["cleaned"] == text


PARTS = st.sampled_from(["word", "end.", "#", "|", "!!", "»", "sign", "in", "Privacy", "policy", "cookies", "we", "use", "。", "…", "'s", "\n", "\n", "\n \n", "•", "\t", "d’utilisation", "conditions", "\u00a0"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=60).map(" ".join), max_size=4))
def test_rules_are_those_of_brute_force(texts):
    known = quality_rules.Words()
    got = list(zip(*[x.to_pylist() for x in quality_rules.judge(pa.array(texts, pa.string()), known)]))
    for text, row in zip(texts, got):
        lines = text.split("\n")
        words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines]
        flat, fails = [w for x in words for w in x], brute_failing(lines)
        seen = Counter(tuple(flat[k : k + 3]) for k in range(len(flat) - 2))
        again = {j for k in range(len(flat) - 2) if seen[tuple(flat[k : k + 3])] > 1 for j in range(k, k + 3)}
        worded = [x for x, w in zip(lines, words) if w]
        want = (len(flat), sum(map(len, flat)), sum(c in "#*$%&|<>" for c in text), len(worded) - len(set(worded)), len(again), len(worded), sum(fails), sum(len(w) for w, f in zip(words, fails) if f))
        assert row[: len(want)] == want and row[-1] == "\n".join(x for x, f in zip(lines, fails) if not f)


# -- WARC ----------------------------------------------------------------------


def test_archives_of_odd_pages(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a.b.c/x", big), (2, "http://a.b.c/x", big), (3, None, None), (4, "http://z/", "<a>"), (5, "http://z/", "<a>"), (6, "weird\nurl\t%", big + "\r\n\r\nWARC/1.1\r\n"), (2, "http://a.b.c/x", big), (2, "http://a.b.c/x", "other"), (None, "http://n/", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit(2))
    got = warc.archived(df, with_payload=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        firsts = [p or -1 for p, _, x in rows if x == h and len(raw) >= 1000]
        revisit = bool(firsts) and (i or -1) != max(firsts)
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(firsts) if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["payload"] is None or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got)
    assert warc.archived(df.filter("false")).count() == 0


def test_very_long_payloads(spark):
    df = spark.range(6).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") < 4, F.repeat(F.lit("<p>long é"), 600_000)).otherwise(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("html"))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect())
    assert got == [*[(i, 6_000_000, "response" if i == 3 else "revisit", None if i == 3 else 3) for i in range(4)], (4, 4, "response", None), (5, 5, "response", None)]


def test_index_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    df = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".org/"), F.col("id").cast("string")).alias("url"), F.lit("x").alias("html"))
    assert {r["page_id"] for r in warc.archived(df).collect()} == set(range(100))


# -- sharding ------------------------------------------------------------------


def test_shards(odd, empty, spark):
    rows = [(i, f"text {i % 40}" if i < 400 else f"own {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for source, n in ((df, 1000), (odd, len(TEXTS))):
        got = sharding.shard_documents(source).collect()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        sizes = [len(by[k]) for k in range(16)]
        assert len(got) == n and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    texts = dict(rows)
    where = defaultdict(set)
    for r in sharding.shard_documents(df).collect():
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        where[texts[r["doc_id"]]].add(r["shard"])
    linked = [len(x) for t, x in where.items() if t.startswith("text")]
    assert sum(linked) / len(linked) < 2
    assert sharding.shard_documents(empty).count() == 0


def test_hot_groups_take_few_shards_and_let_others_join(spark):
    texts = ["hot"] * 480 + [f"group {k % 60}" for k in range(240)] + [f"own {k}" for k in range(720)]
    where = defaultdict(set)
    for r in sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        where[texts[r["doc_id"]]].add(r["shard"])
    assert len(where["hot"]) == 6  # of 90 rows each
    assert all(len(where[f"group {k}"]) == 1 for k in range(60))


def test_flows_overfill_no_shard():
    rng = random.Random(9)
    for _ in range(200):
        wished = {(s, t): rng.randint(1, 50) for s in range(5) for t in range(5) if s != t and rng.random() < 0.5}
        room = [rng.randint(-5, 30) for _ in range(5)]
        met = sharding.flows(wished, room)
        assert all(0 <= met[k] <= n for k, n in wished.items())
        assert all(sum(n for (_, t), n in met.items() if t == k) - sum(n for (s, _), n in met.items() if s == k) <= max(room[k], 0) for k in range(5))
    assert sharding.flows({(0, 1): 7, (1, 0): 7}, [0, 0]) == {(0, 1): 7, (1, 0): 7}


# -- pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns and docs.count() <= before.count()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_leaves_what_its_result_reads(spark, sf):
    import corpus_pipeline

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    packed = corpus_pipeline.run(spark, sf)
    left = {x.partition("-")[0] if x.startswith("pieces") else x.rpartition("-")[0] for x in set(os.listdir(shared)) - before}
    assert left <= {"pieces", "pipeline-suffix-array"} and packed.count() > 0


def brute_pipeline(rows, good):
    """Pieces of documents, by each stage's rules in plain Python."""
    kept = {i for i, x in brute_resampled(rows, good).items() if x[3]}
    found = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    clean = []
    for i, t in rows:
        lines, w = (t or "").split("\n"), found(t or "")
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        failing = brute_failing(lines)
        lost = sum(len(found(x)) for x, f in zip(lines, failing) if f)
        if i in kept and len(w) >= 50 and 2 * len(repeated) <= len(w) and 2 * lost <= len(w):
            clean.append((i, "\n".join(x for x, f in zip(lines, failing) if not f)))
    clean.sort()
    _, tops = brute_classes([t for _, t in clean])
    clean = [x for k, x in enumerate(clean) if tops[k] == k]
    counts = Counter(t.encode()[k : k + 200] for _, t in clean for k in range(len(t.encode()) - 199))
    pieces = Counter()
    for i, t in clean:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if counts[raw[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        ids = [*bpe.vocabulary(VOCABULARY).whole.encode(left, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            pieces[i, k, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
    return pieces


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 4)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(line(12) for _ in range(6))
    rows = []
    for i in range(70):
        lines = [line(rng.randint(8, 20)) for _ in range(rng.randint(4, 12))]
        if i % 6 == 0:
            lines.insert(1, passage)
        if i % 5 == 0:
            lines += ["Home | About | Contact | Help", " ".join(word() for _ in range(15))]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 30, 3)]
    rows += [(200 + i, " ".join(f"{rng.choice('xyzw') * 3}###" for _ in range(80))) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "short text."), (303, line(9000))]
    good = {i for i, _ in rows if i < 200 and i % 2}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(rows, good)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want and len(want) > 40
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048 for x in held.values())


def test_stages_of_an_empty_table_and_of_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns and out.count() <= table.count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gleaner.llm import common

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(unset)
