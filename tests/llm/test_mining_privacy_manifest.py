import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import hard_negatives, merkle, pii
from gleaner.llm.queries import QUERIES

CLASHING = ("a", "j", "v", "dim", "cell", "salt", "part", "far", "ps", "kth", "score", "rank", "id", "row", "kind", "name", "base", "spans", "mentions", "at", "of", "known", "member", "digest", "place", "bucket", "tie", "c0", "proof_")


def with_clashes(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING if c not in taken])


# -- hard negatives ------------------------------------------------------------


def brute_negatives(rows, anchors, k=5, m=3):
    rows = [(i, l, [int(np.floor(256.0 * x)) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, l, v in {(i, l, tuple(v)) for i, l, v in rows if i in anchors}:
        scored = [(sum(x * y for x, y in zip(v, w)), j, own) for j, own, w in rows if len(w) == len(v)]
        near = sorted(((-s, j) for s, j, own in scored if own == l and j != i))[:k]
        for p, j in near:
            fits = sorted((-s, n) for s, n, own in scored if own != l and 50 * -p <= 100 * s <= 95 * -p)[:m]
            out.update((i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits, 1))
    return out


def mined(df, anchors):
    return Counter(map(tuple, hard_negatives.hard_negatives(df, df.filter(F.col("vec_id").isin(list(anchors)))).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, seed):
    """Many cells, blocks, parts and leaves, clustered vectors, ties, repeated rows, one vector and label of a third of the rows."""
    for name, n in {"CELL_VALUES": 200, "BLOCK_VALUES": 160, "ANCHOR_VALUES": 16, "LEAF": 4, "TOGETHER": 3}.items():
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(240)]
    rows += [(i, 1, centres[0]) for i in range(240, 380)] + [(245, 1, centres[0])] * 9 + [(250, 2, centres[0])] * 4 + [(i, i % 3, [float(round(x)) for x in centres[1]]) for i in range(380, 400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    anchors = {i for i, _, _ in rows if i % 13 == 0 or i in (245, 250)}
    want = brute_negatives(rows, anchors)
    assert mined(with_clashes(df), anchors) == want and len(want) > 100


def test_negatives_of_odd_rows(spark):
    odd = [(0, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (50, 1, None), (100, 1, [None, 1.0]), (150, 1, [float("nan"), 1.0]), (200, 1, [float("inf"), 0.0]), (250, 1, [0.0, 0.0]), (251, 1, [0.0, 0.0]), (252, 2, [0.0, 0.0]), (300, 1, []), (301, 1, []), (302, 2, [])]
    odd += [(350, 1, [1e12, 3.0]), (351, 1, [1e12, 1.0]), (352, 2, [7e11, 1.0]), (353, 2, [7e11, 2.0]), (400, 3, [1.0, 1.0, 1.0]), (401, 3, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(odd, "vec_id long, label int, embedding array<double>")
    anchors = {i for i, _, _ in odd if i is not None and i % 50 == 0}
    want = {x: n for x, n in brute_negatives(odd, anchors).items()}
    least, most = hard_negatives.LEAST, hard_negatives.GREATEST
    got = mined(df, anchors)
    assert {x[:4] for x in got if x[0] != 350} == {x[:4] for x in want if x[0] != 350}
    assert all(least <= s <= most for x in got for s in x[4:])
    assert hard_negatives.hard_negatives(df.filter("false"), df.filter("false")).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(-(1 << 62), 1 << 62), min_size=1, max_size=20))
def test_percentages_are_exact(values):
    p = np.array(values)
    assert hard_negatives.percent(p, 50, True).tolist() == [-((-50 * v) // 100) for v in values]
    assert hard_negatives.percent(p, 95, False).tolist() == [95 * v // 100 for v in values]


def test_pruning_skips_what_lies_outside(monkeypatch):
    """Far clusters are never scored."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 3, (400, 8)) + 1000 * np.eye(8)[c] for c in range(8)]).round()
    tree = hard_negatives.BallTree(x, np.arange(len(x)), np.zeros(len(x), np.int64))
    scored = []
    whole = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, x: scored.append(len(x)) or whole(a, x))
    low, high = np.full((1, 1), hard_negatives.LEAST), np.full((1, 1), hard_negatives.GREATEST)
    found = hard_negatives.search(x[:1], np.zeros(1, np.int64), np.zeros(1, np.int64), low, high, tree, 5, True)
    order = sorted(range(1, len(x)), key=lambda i: (-(x[0] @ x[i]), i))[:5]
    assert found.id[0, 0].tolist() == order and sum(scored) <= 800


# -- personal data ---------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_rule(text):
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    valid = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(text)], "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and valid(digits(m))], "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("ab.@c-_%+é", max_size=40), st.text("0123456789. -", max_size=60), st.text("+1 ()-.29@x", max_size=40), st.text(".1203", max_size=40)))
def test_base_rules_are_the_expressions(text):
    assert pii.base_spans(text) == by_rule(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "4111-1111-1111-1111 4", "1.2.3.4.5.6.7.8", "01.002.255.256 1.2.3.255", "a@b.c.d@e.f_g@h.i", "+1 (212) 555-0101 4111111111111111", "٣٤٥@x.y +٣٤٥٦٧٨٩٠"])
def test_base_rules_on_borders(text):
    assert pii.base_spans(text) == by_rule(text)


def test_rules_are_linear_in_long_texts():
    for text in ("x" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "1." * 500_000, "+1 " * 500_000, "a (at) " * 200_000, "1:" * 500_000):
        pii.mentions(text)


def brute_known(texts):
    """Identifiers known after the rounds, in plain Python."""
    each = [m for t in texts for m in pii.mentions(t or "")[1]]
    edges = Counter((k, n, p) for k, n, _, _, _, ps in each for p in ps)
    stands = Counter()
    for t in texts:
        w = pii.words(t or "")
        stands.update(f"L {a}" for a in w[:-1])
        stands.update(f"L {a} {b}" for a, b in zip(w[:-1], w[1:-1]))
        stands.update(f"R {a} {b}" for a, b in zip(w[1:], w[2:]))
    known = {(k, n): 1.0 for k, n, seed, *_ in each if seed}
    for _ in range(pii.ROUNDS):
        weight, different = Counter(), Counter()
        for (k, n, p), c in edges.items():
            if (k, n) in known and p in stands:
                weight[k, p] += c * known[k, n]
                different[k, p] += 1
        trusted = {x: min(0.99, v / max(v, stands[x[1]])) for x, v in weight.items() if different[x] >= pii.MIN_KNOWN}
        doubt = defaultdict(lambda: 1.0)
        for k, n, p in edges:
            if (k, n) not in known and trusted.get((k, p), 0) >= pii.MIN_PATTERN:
                doubt[k, n] *= 1 - trusted[k, p]
        new = {x: 1 - d for x, d in doubt.items() if 1 - d >= pii.MIN_INSTANCE}
        if not new:
            break
        known |= new
    return set(known)


def brute_spans(texts):
    known = brute_known(texts)
    out = []
    for t in texts:
        base, ms = pii.mentions(t or "")
        added = {(pii.KINDS.index(k), a, b) for k, n, seed, a, b, _ in ms if not seed and (k, n) in known}
        out.append((",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(added | {(pii.KINDS.index(k), a, b) for k in pii.KINDS for a, b in base[k]})), len(added)))
    return out


def letters(rng):
    """Texts in which some contexts tell a kind and others don't."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 4)))
    talk = lambda n: " ".join(word() for _ in range(n))
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"{talk(9)} Phone: +1 ({rng.randint(200, 999)}) {number()} {talk(4)}" for _ in range(40)]
    texts += [f"{talk(5)} phone: {number()} reach us {talk(4)}" for _ in range(12)] + [f"{talk(3)} mobile {number()} reach us {talk(4)}" for _ in range(5)]
    texts += [f"{talk(3)} mobile {number()}; {talk(2)}", f"{talk(6)} part {number()} of {talk(5)}", f"part {number()} of {talk(5)}"] * 2
    texts += [f"write to a{i}@mail.org please {talk(3)}" for i in range(5)] + ["write to bob (at) mail (dot) org please", "see a1 (at) mail [dot] org", "write to us"]
    texts += [f"host {rng.randint(1, 255)}.1.2.{i} is up {talk(3)}" for i in range(4)] + ["host fe80::1:2 is up", "at 12:30:45 it rang"]
    return texts + ["the the the " + talk(300), "", None, "4111 1111 1111 1111", "x" * 5000, "word " * 30_000]


def test_bootstrapped_spans_are_those_of_brute_force(spark):
    texts = letters(random.Random(5))
    df = with_clashes(spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(3)
    got = pii.personal_data(df).select("doc_id", "base", "spans", "n_added", "n_email", "n_ip", "n_card", "n_phone").collect()
    want = brute_spans(texts)
    bases = [pii.listed(by_rule(t or "")) for t in texts]
    assert Counter((r["doc_id"], r["base"], r["spans"], r["n_added"]) for r in got) == Counter((i if i % 9 else None, b, *w) for i, (b, w) in enumerate(zip(bases, want)))
    assert all(r["n_email"] == r["base"].count("email") and r["n_ip"] == r["base"].count("ip") and r["n_card"] == r["base"].count("card") and r["n_phone"] == r["base"].count("phone") for r in got)
    found = {texts[i] for i, (_, n) in enumerate(want) if n and texts[i]}
    assert sum("phone: " in t for t in found) == 12 and sum(" mobile " in t for t in found) >= 5  # the second round's
    assert "write to bob (at) mail (dot) org please" in found and "see a1 (at) mail [dot] org" in found and "host fe80::1:2 is up" in found
    assert not any("part " in t or "rang" in t for t in found)
    assert pii.personal_data(df.filter("false")).count() == 0


def test_copies_prove_nothing(spark):
    """A context of many copies of one identifier isn't trusted."""
    rows = [(i, "Ring +1 (212) 555-0101 now") for i in range(50)] + [(90, "Ring 333-4444-55 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.personal_data(df).agg(F.sum("n_added")).first()[0] == 0


def test_counts_of_base_spans_on_the_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_spans(list(docs.values()))
    got = {r["doc_id"]: r for r in QUERIES["op12_personal_data"](spark, sf).collect()}
    for (i, t), (spans, n) in zip(docs.items(), want):
        base = pii.listed(by_rule(t or ""))
        assert (got[i]["base_sha256"], got[i]["spans"], got[i]["n_added"]) == (hashlib.sha256(base.encode()).hexdigest(), spans, n)


# -- Merkle manifest -----------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        low = i // 8 * 8
        out += [x for k, x in enumerate(nodes[low : low + 8], low) if k != i]
        i //= 8
    return "".join(out)


def brute_manifest(rows):
    """(key, leaf, subroot, root, proof) of (group, key, leaf)."""
    groups = defaultdict(list)
    for g, key, leaf in rows:
        groups[g].append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    return Counter(
        (known and key or (0 if known else None), leaf, trees[g][-1][0], top[-1][0], path(trees[g], i) + path(top, at))
        for at, g in enumerate(order) for i, (known, key, leaf) in enumerate(sorted(groups[g]))
    )


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_that_of_brute_force(spark, monkeypatch, levels):
    """Groups of every awkward size, null keys and groups, repeated rows, a group of most rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", 8**levels)
    rng = random.Random(levels)
    sizes = {None: 9, "": 1, "en": 700, "ü": 64, "zz": 65, "a": 8, "b": 2, **{f"g{i}": 1 for i in range(12)}}
    rows = [(g, rng.randint(-50, 10**12) if rng.random() < 0.9 else None, sha(str(rng.randrange(400)))) for g, n in sizes.items() for _ in range(n)]
    rows += [("en", 7, sha("same"))] * 60
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(6)
    found = merkle.manifest(with_clashes(df)).withColumn("again", merkle.folded_root(*[F.col(c) for c in ("leaf", "at", "of", "group_at", "groups", "proof")]))
    got = found.collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == brute_manifest(rows)
    assert all(r["again"] == r["root"] and r["c0"] == 1 for r in got)
    assert all(sorted(r["at"] for r in got if r["lang"] == g) == list(range(sum(x[0] == g for x in rows))) for g in sizes)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([("en", 1, sha("x"))], "lang string, doc_id long, leaf string")
    one = merkle.manifest(df).first()
    assert (one["subroot"], one["root"], one["proof"], one["of"], one["groups"]) == (sha("x"), sha("x"), "", 1, 1)
    assert merkle.manifest(df.filter("false")).count() == 0


def test_leaves_of_odd_rows(spark):
    rows = [(1, None), (None, ""), (-5, "é日"), (2, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", merkle.leaf_of(F.col("doc_id"), F.col("text")).alias("leaf"))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert all(r["leaf"] == sha(field(r["doc_id"]) + field(r["text"])) for r in df.collect())


def test_a_changed_leaf_or_proof_is_found_out(spark, sf):
    found = QUERIES["op13_merkle_manifest"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tampered = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").rlike("[A-Z]")).select("doc_id")
    assert found.filter("not verified").select("doc_id").exceptAll(tampered).count() == 0 == tampered.exceptAll(found.filter("not verified").select("doc_id")).count()
    assert found.count() == docs.count()


@pytest.mark.parametrize("most", [0, 100])
def test_texts_stay_where_they_are_while_few_rows_go(spark, monkeypatch, most):
    """Rows that go are broadcast up to a bound, so the texts aren't dealt out; beyond it the result is the same."""
    from gleaner.llm import ngram_join as n

    monkeypatch.setattr(n, "MOST_ROWS", most)
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(i, words(i % 40), f"o{i}") for i in range(120)] + [(None, words(3), "null"), (500, None, "none"), (501, "", "empty"), (7, words(7), "o7")]
    left = []
    out = n.one_of_each(session.createDataFrame(rows, "doc_id long, text string, other string"), left=left)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 0) and len(left) == 2
    assert sorted(r["other"] for r in out.collect()) == sorted([*[f"o{i}" for i in range(40)], "none", "empty"])
