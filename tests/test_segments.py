import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators import cells
from gleaner.operators import search as s
from gleaner.operators import trigrams
from gleaner.operators.chunking import build_chunks
from gleaner.plans.engine import Engine
from gleaner.sources import bundle as b
from gleaner.sources import scan
from gleaner.sources.scan import DOCUMENTS, Source, list_files, listed, read_files

# -- segments ------------------------------------------------------------------------


def table(spark, files):
    """Documents of {(source, path): (text, time)}."""
    rows = [(src, f"/{src}", f"/{src}/{rel}", rel, rel.rpartition(".")[2], body, len(body.encode()), F_TIMES[when]) for (src, rel), (body, when) in files.items()]
    return spark.createDataFrame(rows, DOCUMENTS).withColumn("content_hash", t.content_hash(F.col("content")))


def _times():
    from datetime import datetime, timezone

    return [datetime(2024, 1, 1 + i, tzinfo=timezone.utc) for i in range(20)]


F_TIMES = _times()


def held(engine):
    chunks = sorted(map(tuple, engine.bundle.chunks().select("source_name", "rel_path", "content", "id").collect()))
    vectors = sorted(r["chunk_id"] for r in engine.bundle.embeddings().collect())
    state = sorted((r["source_name"], r["rel_path"], r["content_hash"], tuple(r["chunk_ids"])) for r in engine.bundle.state().collect())
    return chunks, vectors, state


def wanted(spark, files):
    docs = table(spark, files)
    made = build_chunks(docs)
    chunks = sorted(map(tuple, made.select("source_name", "rel_path", "content", "id").collect()))
    ids = {}
    for r in sorted(made.collect(), key=lambda r: r["chunk_index"]):
        ids.setdefault((r["source_name"], r["rel_path"]), []).append(r["id"])
    return chunks, sorted(c[-1] for c in chunks), sorted((r["source_name"], r["rel_path"], r["content_hash"], tuple(ids.get((r["source_name"], r["rel_path"]), []))) for r in docs.collect())


def test_syncs_of_every_kind_equal_a_rebuild(spark, tmp_path):
    """Files come, change, go, come back with what they held before; segments are compacted on the way."""
    rng = random.Random(4)
    body = lambda k: f"words of kind {k} " * (40 + 200 * (k % 3))
    files = {(f"s{i % 2}", f"f{i}.md"): (body(i), 0) for i in range(30)}
    engine = Engine.init(spark, str(tmp_path))
    engine.rebuild(table(spark, files))
    gone, names = {}, set()
    for step in range(1, 7):
        before = engine.bundle.chunks()
        old = dict(files)
        for key in rng.sample(sorted(files), 3):
            gone[key] = files.pop(key)
        for key in rng.sample(sorted(files), 2):
            files[key] = (body(rng.randrange(60)), step)
        files[f"s{step % 2}", f"new{step}.md"] = (body(step), step)
        if step % 2 == 0:
            back = rng.choice(sorted(gone))
            files[back] = (gone.pop(back)[0], step)
        got = engine.sync(table(spark, files))
        names |= {x["name"] for x in engine.bundle.manifest()["segments"]}
        assert held(engine) == wanted(spark, files)
        assert got["deleted"] == len(old.keys() - files.keys()) and engine.status()["files"] == len(files)
        assert before.count() == len(wanted(spark, old)[0])  # a reader's plan of the version before still works
    assert len(engine.bundle.manifest()["segments"]) < 7 <= len(names)
    assert engine.bundle.compact(whole=True)["segments"][1:] == [] and held(engine) == wanted(spark, files)
    assert engine.sync(table(spark, files))["unchanged"] == len(files)


def test_a_small_sync_writes_little(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    files = {("s", f"f{i}.txt"): (" ".join(word() for _ in range(400)), 0) for i in range(1500)}
    engine = Engine.init(spark, str(tmp_path))
    engine.rebuild(table(spark, files))
    whole = engine.bundle.size()
    for i in range(15):
        files["s", f"f{i * 7}.txt"] = (" ".join(word() for _ in range(400)), 1)
    found = engine.sync(table(spark, files))
    assert found["changed"] == 15 and engine.bundle.size(found["segments"][-1]["name"]) < 0.05 * whole


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    files = {("s", f"f{i}.txt"): (f"words {i}", 0) for i in range(8)}
    engine = Engine.init(spark, str(tmp_path))
    engine.rebuild(table(spark, files))
    was, version = held(engine), engine.bundle.manifest()
    changed = files | {("s", "f1.txt"): ("other words", 1)}
    monkeypatch.setattr(b.Bundle, "_save", lambda *_: (_ for _ in ()).throw(OSError("no room")))
    for broken in (lambda: engine.sync(table(spark, changed)), lambda: engine.bundle.compact(whole=True) if len(version["segments"]) > 1 else engine.rebuild(table(spark, changed))):
        with pytest.raises(OSError):
            broken()
        assert engine.bundle.manifest() == version and held(engine) == was
    monkeypatch.undo()
    assert engine.sync(table(spark, changed))["changed"] == 1 and held(engine) == wanted(spark, changed)
    begun, segment = engine.bundle.begin()
    engine.sync(table(spark, files | {("s", "f2.txt"): ("third", 2)}))
    with pytest.raises(b.Conflict):
        engine.bundle.commit(begun, segment, 0, range(0, 0))


@settings(deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60))
def test_compaction_keeps_segments_few_and_rewrites_little(sizes):
    kept, written = [], 0
    for n in sizes:
        kept.append(n)
        run = b.run_to_compact(kept, 0, 10)
        if run:
            assert run[1] == len(kept) - 1 and run[1] - run[0] >= b.RUN - 1
            written += sum(kept[run[0] :])
            kept = [*kept[: run[0]], sum(kept[run[0] :])]
    assert sum(kept) == sum(sizes) and len(kept) <= 3 + 3 * (sum(sizes)).bit_length()
    assert written <= sum(sizes) * (2 + 2 * len(sizes).bit_length())
    assert b.run_to_compact([5, 1], 11, 10) == (0, 1) and b.run_to_compact([5], 11, 10) is None


# -- scans ------------------------------------------------------------------------------


def tree(top, n):
    for i in range(n):
        folder = top / f"d{i % 7}" / ("node_modules" if i % 11 == 0 else f"e{i % 5}") / f"g{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.{('md', 'txt', 'exe')[i % 3]}").write_text(f"text {i}")
    (top / "d1/.gitignore").write_text("*1.txt\n!f2*1.txt\ne3/\n")
    (top / ".gitignore").write_text("d5/e1\n")


@pytest.mark.parametrize("budget", [1, 20, 10_000])
def test_executors_list_what_one_walk_lists(spark, tmp_path, monkeypatch, budget):
    """Whatever is handed on from level to level, with the ignore rules above it; through a store's paths too."""
    monkeypatch.setattr(scan, "BUDGET", budget)
    tree(tmp_path / "top", 300)
    source = Source("s", str(tmp_path / "top"), exclude_patterns=["d6/**"])
    want = sorted(r for _, r in listed(source))
    assert len(want) > 100 and want == sorted(r for _, r in listed(Source("s", f"file://{tmp_path}/top", exclude_patterns=["d6/**"])))
    got = list_files(spark, [source, Source("off", "/none", enabled=False)], work=f"file://{tmp_path}/work").collect()
    assert sorted(r["rel_path"] for r in got) == want and all(r["byte_size"] == os.path.getsize(r["abs_path"]) for r in got)


def test_files_of_the_same_time_are_not_opened(spark, tmp_path):
    """Contents that would be left out if anybody read them, behind the times of before."""
    tree(tmp_path / "top", 40)
    engine = Engine.init(spark, str(tmp_path / "base"))
    engine.add_source(str(tmp_path / "top"), "s")
    n = engine.index()["file_count"]
    paths = sorted(p for p, _ in listed(engine.sources()[0]))
    for p in paths[:-3]:
        about = os.stat(p)
        with open(p, "wb") as f:
            f.write(b"\xff\xfe not text")
        os.utime(p, ns=(about.st_atime_ns, about.st_mtime_ns))
    os.unlink(paths[-1])
    with open(paths[-2], "w") as f:
        f.write("new words of a file that is read")
    os.utime(paths[-2], (2_000_000_000, 2_000_000_000))
    found = engine.sync()
    assert (found["new"], found["changed"], found["deleted"], found["unchanged"]) == (0, 1, 1, n - 2)
    with open(paths[0], "ab") as f:  # of a new time, it is read, and isn't text any more
        f.write(b"\xff")
    os.utime(paths[0], (2_000_000_000, 2_000_000_000))
    assert engine.sync()["deleted"] == 1
    assert read_files(list_files(spark, engine.sources())).count() == 2


# -- trigrams -----------------------------------------------------------------------------


def meets(asked, grams):
    kind, parts = asked
    if kind == "all":
        return set(parts) <= grams
    return (all if kind == "both" else any)(meets(x, grams) for x in parts)


PIECES = st.sampled_from(["abc", "river", "é", "x", "the ", "(ab|river)", "(?:foo|bar)+", "a*", "[a-z]", ".", r"\d", r"\bword", "(abcd)?", "end$", "^top", "a{2,3}", "(x|)", "(?=see)", "ß", "ſt", "K", r"\.", "(q(uick|iet))", r"\p{L}", "[a[b]]", "(?i:ABC)", "++"])
LINES = st.lists(st.sampled_from(["abc", "river", "é", "x", "the ", "foo", "bar", "word", "abcd", "end", "top", "aa", "SS", "ST", "k", ".", "1", "quick", "QUIET", "see", " "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4).map("".join), LINES)
def test_a_line_that_matches_holds_what_is_asked(pattern, line):
    asked = trigrams.condition(pattern)
    try:
        found = re.search(pattern, line, re.I)
    except re.error:
        return
    if asked and found:
        assert meets(asked, set(trigrams.grams_of(line).tolist()))


def test_conditions():
    grams = lambda x: ("all", tuple(trigrams.grams_of(x).tolist()))
    assert trigrams.condition("River") == ("both", (grams("river"),))
    assert trigrams.condition("(foo|bars)x+") == ("both", (("any", (("both", (grams("foo"),)), ("both", (grams("bars"),)))),))
    for pattern in ("ab", ".*", "(abc)?", "(abc|)", "a|bcd", r"\Qabc\E", "[a[b]]cde", "(?x) abc d", "(unclosed", r"\p{Lu}abc"):
        assert trigrams.condition(pattern) is None
    assert len(trigrams.condition("a literal of very many characters")[1][0][1]) <= trigrams.ASKED


def test_case_is_folded_as_expressions_fold_it(spark):
    """Characters that match each other regardless of case have one trigram."""
    java = spark._jvm.java.lang.Character
    cased = [c for c in range(0x1E944) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c))]
    groups = {}
    for c in cased:
        groups.setdefault(java.toLowerCase(java.toUpperCase(c)), set()).add(int(trigrams._folded()[c]))
    assert len(cased) > 2000 and all(len(x) == 1 for x in groups.values())


@pytest.mark.parametrize("pattern", ["secret of", "(river|mountain) [a-z]+", "zq", "note 1[0-9]", "(?i)RIVER.*stone", "nothing of this kind", "x*"])
def test_search_with_the_index_is_the_scan(spark, tmp_path, pattern):
    engine, files = _searched(spark, tmp_path)
    docs = table(spark, files)
    with_index = sorted(map(tuple, engine.search(pattern, "exact", limit=100, documents=docs).select("file_path", "start_line", "snippet").collect()))
    plain = sorted((r["file_path"], r["line_number"], r["line_text"]) for r in s.exact_lines(docs, pattern, 500).collect())[:100]
    assert with_index == plain
    if pattern == "secret of":
        looked = engine._documents(docs, "", pattern).count()
        assert looked == 5 + 2  # those that hold it, and two that the index doesn't know


_MADE = {}


def _searched(spark, tmp_path):
    """An engine with two segments, and documents of which two are newer than it."""
    if not _MADE:
        body = lambda i: f"note {i}\nthe RIVER ran past stone {i}\n" + ("the secret of it\n" if i % 8 == 0 else "") + "words\n" * (i % 5)
        files = {("s", f"f{i:02d}.txt"): (body(i), 0) for i in range(40)}
        engine = Engine.init(spark, str(tmp_path))
        engine.rebuild(table(spark, files))
        files["s", "f03.txt"] = ("a mountain view\n", 1)
        engine.sync(table(spark, files))
        files["s", "f04.txt"] = ("the secret of another\n", 2)
        files["s", "new.txt"] = ("river bank\n", 2)
        _MADE["x"] = (engine, files)
    return _MADE["x"]


# -- vectors in cells -------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 7, 50, 5000, 0])
def test_search_by_cells_is_the_scan(spark, tmp_path, k):
    """Clusters, ties, vectors without a direction and of another length; queries near, far and without a direction."""
    rng = np.random.default_rng(k)
    heads = rng.normal(size=(12, 16))
    rows = [(f"v{i:04d}", (heads[i % 12] * rng.uniform(0.1, 9) + 0.1 * rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(f"t{i}", heads[3].tolist()) for i in range(9)] + [("null", None), ("zero", [0.0] * 16), ("empty", []), ("short", heads[3][:5].tolist())]
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    sample = [heads[i % 12].tolist() for i in range(30)] + [None, [], [1.0]]
    centres = cells.centres_of(sample, 20)
    path = str(tmp_path / "v")
    cells.with_cells(vectors, centres).write.partitionBy("cell").parquet(path)
    written = spark.read.parquet(path)
    listed = cells.cells_of(written, centres).collect()
    assert sum(c["n"] for c in listed) == len(rows) and len(centres) == 12
    read = lambda some: written.filter(F.col("cell").isin([c["cell"] for c in some]))
    plain = spark.read.parquet(path).select("chunk_id", "vector")
    for query in (heads[3].tolist(), (-heads[5]).tolist(), rng.normal(size=16).tolist(), [0.0] * 16, heads[0][:4].tolist()):
        found, share = cells.top_k_by_cells(read, listed, query, k)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, s.vector_top_k(plain, query, k).collect()))
        if k == 7 and query == heads[3].tolist():
            assert share < 0.2


def test_search_reads_few_cells_of_a_bundle(spark, tmp_path, monkeypatch):
    """Cells of several segments, with dead rows among them."""
    import gleaner.plans.engine as e

    monkeypatch.setattr(e, "CELL_ROWS", 10)
    topics = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefgh"]
    files = {("s", f"f{i:03d}.txt"): (f"{topics[i % 8]} note{i}", 0) for i in range(120)}
    engine = Engine.init(spark, str(tmp_path))
    engine.rebuild(table(spark, files))
    for i in range(20, 26):
        files["s", f"f{i:03d}.txt"] = (f"{topics[0]} changed{i}", 1)
    engine.sync(table(spark, files))
    for query in (topics[0], topics[5] + " note13", "nothing like it"):
        vector = engine.query_vector(query)
        found, share = engine.bundle.nearest(vector, 6)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, s.vector_top_k(engine.bundle.embeddings(), vector, 6).collect()))
        assert share < 0.6 or query != topics[0]  # a topic that the sample has missed shares a wide cell


# -- functions for SQL ------------------------------------------------------------------------


def test_chunks_in_sql_are_those_of_tables(spark):
    from gleaner.functions.registered import register_chunks
    from gleaner.operators.chunking import Chunking

    rng = random.Random(8)
    parts = ["# Head é\n", "## Two ##\n", "####### no\n", "#\n", "word wörd \u00a0\n", "  def f_1(x):\n", "class A(B):\n", "func (t *T) go(x int) {\n", "type S struct {\n", "const f = async (x) => {\n", "pub fn x() {\n", "\n", " \t \n", "日本 " * 30, "x" * 150, "export abstract class Q {\n"]
    files = {("s", f"f{i}.{rng.choice(['md', 'py', 'go', 'ts', 'rs', 'txt', 'exe', 'js', 'MD'])}"): ("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), 0) for i in range(150)}
    docs = table(spark, files).withColumn("extension", F.lower("extension"))
    columns = ["id", "rel_path", "content", "start_line", "end_line", "chunk_index", "kind", "language", "title", "headings_json", "content_hash", "function_name", "section_level"]
    for config in (Chunking(120, 30, 20), Chunking(60, 0, 0, False), Chunking(100, 10, 90)):
        register_chunks(spark, "chunks", config)
        docs.createOrReplaceTempView("gleaner_docs")
        got = spark.sql("SELECT d.rel_path AS rel_path, c.* FROM gleaner_docs d, LATERAL chunks(d.content, d.source_name, d.rel_path) c").select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build_chunks(docs, config).select(columns).collect()))


# -- streams ---------------------------------------------------------------------------------


def test_a_replayed_batch_does_nothing(spark, tmp_path):
    from gleaner.streaming.watch import watch

    engine = Engine.init(spark, str(tmp_path / "base"))
    first = {("s", f"f{i}.txt"): (f"words {i}", 0) for i in range(5)}
    second = {("s", "f1.txt"): ("other words", 1), ("s", "f9.txt"): ("new words", 1)}
    where = str(tmp_path / "in")
    run = lambda: watch(engine, spark.readStream.schema(table(spark, first).schema).parquet(where), str(tmp_path / "ck")).awaitTermination()
    table(spark, first).write.parquet(where)
    run()
    table(spark, second).write.mode("append").parquet(where)
    run()
    was, serial = held(engine), engine.bundle.manifest()["serial"]
    assert was == wanted(spark, first | second) and engine.status()["files"] == 6
    os.unlink(tmp_path / "ck/commits/1")  # as if the query had died just before it noted the batch
    if os.path.exists(tmp_path / "ck/commits/.1.crc"):
        os.unlink(tmp_path / "ck/commits/.1.crc")
    run()
    assert engine.bundle.manifest()["serial"] == serial and held(engine) == was
