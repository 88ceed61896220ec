import os
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.functions import vectors as v
from gleaner.functions.arrays import running
from gleaner.functions.catalog import MODELS
from gleaner.operators import chunking
from gleaner.operators import search as s
from gleaner.operators.chunking import Chunking, build_chunks, windows
from gleaner.plans import output
from gleaner.plans.config import Config, ConfigError
from gleaner.plans.engine import Engine
from gleaner.sources.scan import DOCUMENTS, Gitignore, Source, glob_regex, listed

SMALL = Chunking(1000, 100, 10)


def documents(spark, *files):
    rows = [(src, f"/{src}", f"/{src}/{rel}", rel, rel.rpartition(".")[2], body, len(body.encode()), None) for src, rel, body in files]
    return spark.createDataFrame(rows, DOCUMENTS)


def chunks(spark, rel, body, config=SMALL):
    return build_chunks(documents(spark, ("s", rel, body)), config).orderBy("chunk_index").collect()


@pytest.mark.parametrize("n, want", [(0, []), (1, [(0, 1)]), (2200, [(0, 2200)]), (2201, [(0, 2200), (1900, 2201)]), (4100, [(0, 2200), (1900, 4100)]), (4101, [(0, 2200), (1900, 4100), (3800, 4101)]), (6000, [(0, 2200), (1900, 4100), (3800, 6000)])])
def test_windows(spark, n, want):
    got = spark.range(1).select(windows(F.lit(0), F.lit(n), 2200, 300).alias("w")).first()["w"]
    assert [(x["s"], x["e"]) for x in got] == want


def test_sections_and_titles(spark):
    body = "# Title\nintro text here\n## Section 1\nsome text here\n## Section 2\nmore text here\n"
    got = chunks(spark, "a.md", body)
    assert [(c["title"], c["section_level"], c["kind"]) for c in got] == [("Title", 1, "markdown"), ("Section 1", 2, "markdown"), ("Section 2", 2, "markdown")]
    assert got[0]["headings_json"] == '["Title","Section 1","Section 2"]'
    assert [(c["start_line"], c["end_line"]) for c in got] == [(1, 3), (3, 5), (5, 7)]


def test_text_before_the_first_heading_is_lost(spark):
    assert [c["content"] for c in chunks(spark, "a.md", "lost words here\n# Kept\nbody text")] == ["# Kept\nbody text"]


def test_long_sections_title_their_first_window_only(spark):
    got = chunks(spark, "a.md", "# Title\n" + "word " * 500 + "\n## Section 2\nmore words here\n")
    assert len(got) > 2 and got[0]["title"] == "Title" and got[0]["section_level"] == 1 and got[1]["section_level"] == 0 and got[1]["title"] == "Title"


@pytest.mark.parametrize(
    "ext, body, names",
    [
        ("go", "package main\n\nfunc main() {\n}\n\nfunc (a *T) helper(x int) {\n}\n\ntype MyStruct struct {\n}\n", ["", "main", "helper", "MyStruct"]),
        ("py", "import os\n\ndef main():\n    pass\n\nclass MyClass:\n    def method(self):\n        pass\n\nasync def async_func(x):\n    pass\n", ["", "main", "MyClass", "method", "async_func"]),
        ("ts", "export abstract class A {\n  some body\n}\nconst f = async (x) => {\n  some body\n}\n", ["A", "f"]),
        ("rs", "pub async fn go(x) {\n some body\n}\npub struct S {\n some body\n}\n", ["go", "S"]),
        ("java", "class A {\n  int x;\n}\n", [""]),
    ],
)
def test_code_is_cut_at_boundaries(spark, ext, body, names):
    assert [c["function_name"] for c in chunks(spark, f"f.{ext}", body, Chunking(1000, 100, 0))] == names


def test_small_windows_are_dropped_but_keep_their_numbers(spark):
    body = "# A\nx\n# B\n" + "words here " * 5 + "\n# C\ny\n"
    assert [c["chunk_index"] for c in chunks(spark, "a.md", body, Chunking(1000, 100, 20))] == [1, 2]


def test_blank_and_empty_files(spark):
    got = build_chunks(documents(spark, ("s", "blank.txt", " \n  "), ("s", "empty.txt", "")), SMALL).collect()
    assert [(c["rel_path"], c["content"]) for c in got] == [("blank.txt", "")]


def test_known_hashes(spark):
    row = spark.range(1).select(t.content_hash(F.lit("Test content")).alias("h"), t.chunk_id(F.lit("src"), F.lit("a.md"), F.lit(0), t.content_hash(F.lit("Test content"))).alias("i")).first()
    assert row["h"] == "bca20547e94049e1ffea27223581c567022a5774" and row["i"] == "734f719a678ef67e87e35330e7660b35709a3d8d"
    assert t.chunking_hash(2200, 300, 400, True) == "fab058534b5f30a9a69259c66e5dca8e3ac23d1f"
    assert v.fnv1a(["hello_world", "", "hello"]).tolist() == [3306612346356305768, v.BASIS, 11831194018420276491]


@pytest.mark.parametrize("word, want", [("café", "cafe"), ("naïve", "naive"), ("résumé", "resume"), ("Zürich", "zurich"), ("Ångström señor", "angstrom senor"), ("", "")])
def test_accents(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(v.normalize_text(F.col("w"))).first()[0] == want


def test_accents_of_all_characters(spark):
    """Every character that has a decomposition or is a mark, others by chance, and texts of several."""
    rng = random.Random(6)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = [c for c in every if v.without_marks(c) != c] + rng.sample(every, 3000)
    texts = [f"a{c}b" for c in own] + ["".join(rng.choice(own[:3000] + list("abc ")) for _ in range(20)) for _ in range(500)] + ["", "plain", "한글 e\u0301 ß"]
    odd = [t for t in texts if "\u302e" in t or "\u302f" in t]  # spacing marks keep their order
    got = spark.createDataFrame([(t,) for t in texts if t not in odd], "t string").select("t", v.strip_accents(F.col("t")).alias("s"))
    assert [(r["t"], r["s"]) for r in got.collect() if r["s"] != v.without_marks(r["t"])] == [] and len(own) > 15_000
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_hash_vector(spark):
    e = v.embed_text("hello world", 384, False)
    assert {i: float(e[i]) for i in e.nonzero()[0]} == {267: 1, 298: 0.5, 371: -1, 140: 0.5, 104: 0.5, 381: 0.25}


def test_cosine_edges(spark):
    rows = [([1.0, 2.0], [2.0, 1.0], 0.8), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [1.0], 0.0), ([1.0, 2.0, 9.0], [2.0, 1.0], 0.8)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, want double").select(v.cosine(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(abs(r["got"] - r["want"]) < 1e-6 for r in got)


def test_fusion_adds_up_lines_and_keeps_the_worst_rank(spark):
    body = "\n".join(f"line {i}" for i in range(1, 9))
    parts = build_chunks(documents(spark, ("s", "a.txt", body), ("s", "b.txt", "other")), SMALL).persist()
    ids = {r["rel_path"]: r["id"] for r in parts.collect()}
    sem = spark.createDataFrame([(ids["a.txt"], 0), (ids["b.txt"], 1), ("gone", 2)], "chunk_id string, rank int")
    lines = spark.createDataFrame([("/s/a.txt", "a.txt", "s", 1, "x", 0), ("/s/c.txt", "c.txt", "s", 3, "y", 1), ("/s/a.txt", "a.txt", "s", 2, "z", 2)], "file_path string, rel_path string, source_name string, line_number long, line_text string, rank int")
    got = {r["chunk_id"]: r for r in s.rrf_fuse(sem, lines, parts, 0).collect()}
    a = got[ids["a.txt"]]
    assert abs(a["score"] - (2 / 61 + 1 / 63)) < 1e-12 and (a["semantic_rank"], a["exact_rank"]) == (0, 2)
    alone = got["exact:/s/c.txt:3"]
    assert abs(alone["score"] - 1 / 62) < 1e-12 and (alone["semantic_rank"], alone["exact_rank"]) == (-1, 1) and "gone" not in got


def test_narrowest_chunk_wins(spark):
    rows = [("a", "/f", 1, 10, 0), ("b", "/f", 4, 6, 1), ("c", "/f", 4, 6, 2), ("d", "/g", 1, 99, 0)]
    parts = spark.createDataFrame(rows, "id string, file_path string, start_line long, end_line long, chunk_index long")
    asked = spark.createDataFrame([("/f", 5), ("/f", 2), ("/f", 50)], "file_path string, line_number long")
    assert {(r["line_number"], r["chunk_id"]) for r in s.match_to_chunk(asked, parts).collect()} == {(5, "b"), (2, "a"), (50, None)}


def test_submatches_are_byte_offsets(spark):
    got = spark.createDataFrame([("é ab Ab",)], "l string").select(s.submatches(F.col("l"), "(?iu)ab")).first()[0]
    assert [(x["start"], x["end"], x["text"]) for x in got] == [(3, 5, "ab"), (6, 8, "Ab")]


@pytest.mark.parametrize("pattern", ["x*", "a|b*", "a{0,2}b?", r"\bx", "^a|c$", "x(?=a)", r"(a|b)\1", "[^a]", "é+", r"$|x", "(?<=a)x+", "(x)(a)?"])
def test_submatches_are_those_of_a_search(spark, pattern):
    rng = random.Random(len(pattern))
    lines = ["abxxc xx", "", "aaaa", "x" * 5000, "\ufdd0x\ufdd0", "$0 \\x"] + ["".join(rng.choice("abcxé日 X") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", s.submatches(F.col("l"), f"(?iu){pattern}").alias("m")).collect()
    for r in got:
        at = lambda n, line=r["l"]: len(line[:n].encode())
        want = [(at(m.start()), at(m.end()), m[0]) for m in re.finditer(f"(?i){pattern}", r["l"]) if m[0]]
        assert [(x["start"], x["end"], x["text"]) for x in r["m"]] == want, r["l"]


def test_running_sums(spark):
    rows = [([3] * n,) for n in (0, 1, 2, 3, 4, 5, 16, 17, 1000)] + [(list(range(77)),)]
    got = spark.createDataFrame(rows, "v array<long>").select("v", running(F.col("v")).alias("r")).collect()
    assert all(r["r"] == [sum(r["v"][:i]) for i in range(len(r["v"]))] for r in got)


@pytest.mark.parametrize("ext", ["md", "txt"])
def test_long_texts_are_cut_as_short_ones(spark, monkeypatch, ext):
    """Windows from the form of four bytes a character, in characters of one to four bytes; many sections and windows."""
    body = "".join(f"# Head {i} é\n" + "wörd 日本 🙂 word\n" * (i % 40) for i in range(300))
    plain = chunks(spark, f"a.{ext}", body)
    assert len(plain) > 90
    monkeypatch.setattr(chunking, "LONG", 10)
    assert [r.asDict() | {"created_at": None} for r in chunks(spark, f"a.{ext}", body)] == [r.asDict() | {"created_at": None} for r in plain]


def test_time_of_chunking_is_linear(spark):
    """Ten times the text with ten times the headings takes no more than some ten times the time."""
    body = "# Head\n" + "word wörd " * 20 + "\n"

    def seconds(n):
        docs = documents(spark, ("s", "a.md", body * n)).cache()
        docs.count()
        began = time.monotonic()
        build_chunks(docs).select(F.sum(F.length("content"))).collect()
        docs.unpersist()
        return time.monotonic() - began

    seconds(2_000)
    assert seconds(40_000) < 25 * max(seconds(4_000), 0.5)


@pytest.mark.parametrize("ranges, want", [([(0, 5)], "[hello] world"), ([(0, 5), (3, 8)], "[hello wo]rld"), ([], "hello world"), ([(20, 30)], "hello world"), ([(6, 11), (0, 2)], "[he]llo [world]")])
def test_highlight(ranges, want):
    assert output.highlight("hello world", ranges).replace(output.ON, "[").replace(output.OFF, "]") == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30))))
@settings(max_examples=50, deadline=None)
def test_merged_ranges_cover_the_same_places(ranges):
    legal = [r for r in ranges if r[0] < r[1] <= 20]
    got = output.merged_ranges(ranges, 20)
    assert {i for a, b in got for i in range(a, b)} == {i for a, b in legal for i in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_ignore_rules(tmp_path):
    for name in ("a.md", "skip.md", "sub/b.md", "sub/c.log.md", "sub/keep.md", "node_modules/d.md", "lib/e.min.js", "x/gen/f.md", "g.bin"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("skip.md\n")
    (tmp_path / "sub/.gitignore").write_text("*.md\n!keep.md\n")
    rels = lambda **how: [r for _, r in listed(Source("s", str(tmp_path), exclude_patterns=["x/**"]), **how)]
    assert rels() == ["a.md", "sub/keep.md"]
    assert rels(strict_parity=True) == ["a.md", "skip.md", "sub/keep.md"]
    assert not list(listed(Source("s", str(tmp_path), include_extensions=[])))
    assert Gitignore("build/\n").ignores("build/x", False) and not Gitignore("build/\n").ignores("build", False)
    assert glob_regex("a/*.md").match("a/b.md") and not glob_regex("a/*.md").match("a/c/b.md")


def test_engine_round(spark, tmp_path):
    top = tmp_path / "notes"
    top.mkdir()
    (top / "auth.md").write_text("# Authentication\n" + "How users log in with passwords. " * 20)
    (top / "main.go").write_text("package main\n\nfunc Login() {\n}\n")
    engine = Engine.init(spark, str(tmp_path / "base"))
    with pytest.raises(ConfigError):
        Engine.init(spark, str(tmp_path / "base"))
    engine.add_source(str(top), "notes")
    with pytest.raises(ConfigError):
        engine.add_source(str(top), "notes")
    assert engine.index()["file_count"] == 2
    for mode in ("semantic", "exact", "hybrid"):
        assert any("auth" in r["file_path"] for r in engine.respond("log in", mode)["results"])
        assert not [x for x in os.listdir(engine.bundle.path) if x.startswith("scan-")]
    assert {r["kind"] for r in engine.search("log", language="go").collect()} <= {"code"}
    assert engine.sync()["unchanged"] == 2
    (top / "main.go").write_text("package main\n\nfunc Deployment() {\n}\n")
    (top / "auth.md").unlink()
    (top / "new.txt").write_text("fresh words")
    got = engine.sync()
    assert (got["new"], got["changed"], got["deleted"]) == (1, 1, 1)
    rebuilt = Engine.init(spark, str(tmp_path / "again"))
    rebuilt.add_source(str(top), "notes")
    rebuilt.index(full=True)
    cols = ["id", "content", "start_line", "end_line", "function_name"]
    assert sorted(map(tuple, engine.bundle.chunks().select(cols).collect())) == sorted(map(tuple, rebuilt.bundle.chunks().select(cols).collect()))
    assert engine.bundle.embeddings().count() == engine.bundle.chunks().count()
    assert engine.files_per_source().first()["files"] == 2 and engine.status()["sources"] == [("notes", 2)] and ("bundle", "ok") in [x[:2] for x in engine.doctor()]


def test_progress_is_told(spark, tmp_path, monkeypatch):
    import gleaner.plans.engine as e

    monkeypatch.setattr(e, "EVERY", 0.01)
    told = []
    engine = Engine(spark, Config(str(tmp_path)), lambda *x: told.append(x))
    engine.bundle.initialize(engine.model)
    engine.rebuild(documents(spark, *[("s", f"f{i}.md", f"# Head {i}\n" + "words " * 300) for i in range(50)]))
    assert {x[0] for x in told} >= {"chunks", "trigrams", "vectors", "state"} and all(0 <= done <= known for _, done, known in told)
    assert any(known > 1 for _, _, known in told) and [x for x in told if x[1:] == (1, 1)][-1][0] == "state"


def test_doctor_and_status_say_what_is_there(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("# A\nwords")
    engine = Engine.init(spark, str(tmp_path / "base"))
    engine.add_source(str(tmp_path / "notes"), "notes")
    engine.config.sources.append(Source("gone", str(tmp_path / "gone")))
    checks = {x[0]: x for x in engine.doctor()}
    assert checks["bundle"][1] == checks["source gone"][1] == checks["model light"][1] == "warn" and checks["source notes"][1] == checks["config"][1] == checks["spark"][1] == "ok"
    assert engine.status()["indexed_at"] == "never" and engine.status()["state"].startswith("empty")
    engine.index(only="notes")
    status = engine.status()
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", status["indexed_at"]) and status["files"] == 1 and {x[0]: x for x in engine.doctor()}["bundle"][1] == "ok"


def test_config_is_validated(tmp_path):
    with pytest.raises(ConfigError):
        Config(str(tmp_path), chunking=Chunking(100, 100, 10)).validate()
    with pytest.raises(ConfigError):
        Config(str(tmp_path), mode="huge").validate()
    c = Config(str(tmp_path), sources=[Source("a b", "/x", exclude_patterns=['q"\\'])])
    c.save()
    assert Config.load(str(tmp_path)).sources == c.sources and set(MODELS) == {"light", "balanced", "quality", "nomic"}


def test_watch_upserts(spark, tmp_path):
    from gleaner.streaming.watch import watch

    engine = Engine.init(spark, str(tmp_path / "base"))
    first = documents(spark, ("s", "a.txt", "alpha words"), ("s", "b.txt", "beta words")).withColumn("content_hash", t.content_hash(F.col("content")))
    engine.rebuild(first)
    documents(spark, ("s", "b.txt", "gamma words")).withColumns({"content_hash": t.content_hash(F.col("content")), "modified_at": F.current_timestamp()}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    watch(engine, stream, str(tmp_path / "ck")).awaitTermination()
    assert {r["content"] for r in engine.bundle.chunks().collect()} == {"alpha words", "gamma words"}


@pytest.mark.parametrize("pattern, lines", [(r"\Afoo", [1, 3]), (r"line\z", [2]), ("^FOO", [1, 3]), ("(?i)x(?!.*line)", [3]), ("(?iu)foo$", [1])])
def test_lines_are_matched_one_by_one(spark, pattern, lines):
    got = s.exact_lines(documents(spark, ("s", "a.txt", "foo\nx the line\nfoo x\n")), pattern, 10).collect()
    assert sorted(r["line_number"] for r in got) == lines


def test_marks_in_output():
    text, ranges = output.clean("  a \t hit\nand a hit", [(6, 9), (16, 19)])
    assert text == "a hit and a hit" and [text[a:b] for a, b in ranges] == ["hit", "hit"]
    shown = output.as_text({"results": [{"file_path": "f", "snippet": 'a "hit"', "matched_terms": [(3, 6)], "score": 1.0, "source_name": "s", "metadata": {"start_line": 1, "end_line": 1, "title": ""}}]})
    assert f"{output.ON}hit{output.OFF}" in shown and "matched_terms" not in output.as_json({"results": [{"matched_terms": []}]})
    assert [output.format_size(n) for n in (5, 2048, 3 << 20, 5 << 29)] == ["5B", "2KB", "3MB", "2.5GB"]


def test_command_line(spark, tmp_path, capsys):
    from gleaner.plans.cli import main

    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("# Plans\nWords about the river and its secret, at some length. " * 12)
    run = lambda *args: main(["--base", str(tmp_path / "base"), *args], spark)
    assert run("status") == 1 and run("init") == 0 and run("source", "add", str(tmp_path / "notes"), "--name", "notes") == 0
    assert run("index", "--full") == 0 and run("search", "river", "--mode", "exact") == 0 and run("status") == 0 and run("doctor") == 0 and run("sync") == 0
    said = capsys.readouterr()
    assert output.ON in said.out and "Total: 1 files" in said.out and "State: indexed" in said.out and "0 new" in said.out and "Error" in said.err
