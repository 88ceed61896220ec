import json
import types

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, processors

from gleaner.functions import models as m
from gleaner.functions import vectors as v
from gleaner.functions import wordpiece as w
from gleaner.functions.catalog import MODELS, Model

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghij.,!?-", *[f"##{c}" for c in "abcdefgh"], "ab", "abc", "##bc", "##cab", "head", "##ache", "bad", "##ge"]


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("model") / "tokenizer.json"
    vocabulary = {x: i for i, x in enumerate(PIECES)}
    path.write_text(json.dumps({"model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 12, "vocab": vocabulary}}))
    return str(path)


@pytest.fixture(scope="module")
def library():
    vocabulary = {x: i for i, x in enumerate(PIECES)}
    out = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=12))
    out.normalizer = normalizers.BertNormalizer(clean_text=False, handle_chinese_chars=False, strip_accents=True, lowercase=True)
    out.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    out.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 2), ("[SEP]", 3)])
    return out


@given(st.text(alphabet="abcdefghijk ABC.,!?-éâ\n\t", max_size=60))
@settings(max_examples=300, deadline=None)
def test_wordpiece_is_the_librarys(file, library, text):
    assert w.WordPiece(file).encode(text) == library.encode(text).ids


def test_wordpiece_limits(file, tmp_path):
    piece = w.WordPiece(file)
    assert piece.pieces("abcabc") == [PIECES.index("abc"), PIECES.index("##a"), PIECES.index("##bc")]
    assert piece.pieces("a" * 13) == [1] and piece.pieces("é" * 7) == [1] and piece.pieces("zz") == [1] and piece.encode("") == [2, 3]
    other = tmp_path / "t.json"
    other.write_text(json.dumps({"model": {"type": "WordPiece", "vocab": {"a": 7}}}))
    assert w.WordPiece(str(other)).encode("a b") == [101, 7, 100, 102]
    other.write_text(json.dumps({"model": {"type": "BPE", "vocab": {}}}))
    with pytest.raises(ValueError):
        w.WordPiece(str(other))


def test_punctuation_and_words():
    assert w.pre_tokenize("don't stop—now (ok)$5") == ["don", "'", "t", "stop", "—", "now", "(", "ok", ")", "$", "5"]
    assert w.plain(" Crème\tBRÛLÉE \n") == "creme brulee"


class Session:
    """States that tell tokens, places and inputs: token id in the first component, its place in the second."""

    def __init__(self, inputs):
        self.inputs, self.sizes = inputs, []

    def get_inputs(self):
        return [types.SimpleNamespace(name=x) for x in self.inputs]

    def run(self, _, given):
        assert set(given) == set(self.inputs) and all((x >= 0).all() for x in given.values())
        ids = given["input_ids"]
        self.sizes.append(ids.shape)
        if (ids == 99).any():
            raise RuntimeError("a session that fails")
        return [np.stack([ids, np.broadcast_to(np.arange(ids.shape[1]), ids.shape), np.ones(ids.shape), np.zeros(ids.shape)], axis=2).astype(np.float32)]


TINY = Model("tiny", "tiny", 4, 6, 1, normalize=False)


@pytest.mark.parametrize("inputs", [("input_ids", "attention_mask"), ("input_ids", "attention_mask", "token_type_ids")])
def test_batches_are_padded_masked_and_pooled(file, tmp_path, inputs):
    (tmp_path / "tokenizer.json").write_text(open(file).read())
    session = Session(inputs)
    texts = ["ab", "", "a b c d e f g h", *["abc"] * 8]
    got, hashed = m.embed_texts(texts, TINY, session, f"{tmp_path}/tokenizer.json")
    assert not any(hashed)
    piece = w.WordPiece(file)
    for text, vector in zip(texts, got):
        ids = piece.encode(text)[:6]
        assert np.allclose(vector, [np.mean(ids), (len(ids) - 1) / 2, 1, 0])
    assert session.sizes == [(8, 6), (3, 3)]


def test_failed_batches_and_missing_tokenizers_are_hashed(tmp_path):
    assert w.hashed_ids("Hello hello") == [w.hashed_id("hello")] * 2 and 1000 <= w.hashed_id("x") < 31000
    session = Session(("input_ids", "attention_mask"))
    good, _ = m.embed_texts(["one two"], TINY, session)
    assert np.allclose(good[0][0], np.mean(w.hashed_ids("one two")))
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": {"bad": 99, "fine": 5}}}))
    w.load.cache_clear()
    texts = ["fine"] * 32 + ["bad", "fine"]
    got, hashed = m.embed_texts(texts, TINY, session, f"{tmp_path}/tokenizer.json")
    assert hashed == [False] * 32 + [True] * 2
    assert np.allclose(got[0], [(101 + 5 + 102) / 3, 1, 1, 0]) and (got[32] == v.embed_text("bad", 4, False)).all() and (got[33] == v.embed_text("fine", 4, False)).all()


def test_pooling_of_nothing_and_unit_length():
    states = np.array([[[3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [1.0, 1.0]]], np.float32)
    got = m.mean_pooled(states, np.array([[1, 0], [0, 0]]), True)
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])


def test_models_come_from_a_mirror(tmp_path, spark):
    light = MODELS["light"]
    repository = light.variants[0][0]
    mirror = tmp_path / "mirror"
    for name, body in (("onnx/model_O3.onnx", "three"), ("onnx/model.onnx", "plain"), ("tokenizer.json", "{}")):
        (mirror / repository / name).parent.mkdir(parents=True, exist_ok=True)
        (mirror / repository / name).write_text(body)
    folder = m.ensure_model(light, str(tmp_path / "models/light"), str(mirror))
    assert open(f"{folder}/model.onnx").read() == "three" and open(f"{folder}/tokenizer.json").read() == "{}" and m.available(folder)
    with pytest.raises(FileNotFoundError):
        m.ensure_model(MODELS["nomic"], str(tmp_path / "models/nomic"), str(mirror))
    assert light.best_first("arm64")[0][1].endswith("qint8_arm64.onnx") and light.best_first("x86_64")[0][1].endswith("O4.onnx")
    got = spark.createDataFrame([("some words",)], "t string").select(m.embedder(MODELS["nomic"])(F.col("t")).alias("x")).first()["x"]
    assert np.allclose(got["vector"], v.embed_text("some words", 768)) and not got["hashed"]
    with pytest.raises(FileNotFoundError):
        m.embedder(MODELS["nomic"], spark, str(tmp_path / "models/nomic"))


# -- a graph made here, under the runtime itself ------------------------------------


def field(number, value):
    """A field of a protocol buffer: a number, bytes or text."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def graph(table, extra=("attention_mask",)):
    """An ONNX model that looks each token id up in a table of vectors; ids beyond it are an error."""
    tensor = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d)) for d in dims))))
    node = field(1, "table") + field(1, "input_ids") + field(2, "states") + field(3, "look") + field(4, "Gather")
    weights = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    inputs = b"".join(field(11, tensor(x, 7, ("n", "l"))) for x in ("input_ids", *extra))
    body = field(1, node) + field(2, "made") + field(5, weights) + inputs + field(12, tensor("states", 1, ("n", "l", "d")))
    return field(1, 8) + field(7, body) + field(8, field(1, "") + field(2, 13))


@pytest.fixture()
def made(tmp_path, monkeypatch):
    """An engine's base whose mode has files: a table of vectors and a small vocabulary."""
    monkeypatch.setitem(MODELS, "light", Model("light", "made", 8, 6, 1))
    folder = tmp_path / "base/models/light"
    folder.mkdir(parents=True)
    table = np.random.default_rng(1).normal(size=(len(PIECES), 8)).astype(np.float32)
    (folder / "model.onnx").write_bytes(graph(table, ("attention_mask", "token_type_ids")))
    vocabulary = {x: i for i, x in enumerate(PIECES)} | {"far": 10_000}
    (folder / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": vocabulary}}))
    return tmp_path / "base", table, folder


def test_a_session_of_the_runtime(made):
    _, table, folder = made
    for extra in ((), ("attention_mask",), ("attention_mask", "token_type_ids")):
        path = folder / f"{len(extra)}.onnx"
        path.write_bytes(graph(table, extra))
        got, hashed = m.embed_texts(["ab", "a b c", "", "abc bad headache"], MODELS["light"], m.open_session(str(path)), f"{folder}/tokenizer.json")
        assert not any(hashed)
        for text, vector in zip(["ab", "a b c", "", "abc bad headache"], got):
            ids = w.load(f"{folder}/tokenizer.json").encode(text)[:6]
            mean = table[ids].mean(axis=0)
            assert np.allclose(vector, mean / np.linalg.norm(mean), atol=1e-5)
    (folder / "broken.onnx").write_bytes(b"no graph")
    with pytest.raises(Exception, match="(?i)protobuf|load"):
        m.open_session(str(folder / "broken.onnx"))


def test_bundles_say_how_they_were_embedded(spark, made):
    """Model's vectors through Spark, batches that fail hashed and counted, and no query in another space than its documents."""
    from pyspark.errors import PythonException

    from gleaner.plans.engine import Engine
    from gleaner.sources.bundle import ModelMismatch
    from gleaner.sources.scan import DOCUMENTS

    base, table, folder = made
    body = lambda name, text: ("s", "/s", f"/s/{name}", name, "txt", text, len(text), None)
    docs = spark.createDataFrame([body("a.txt", "ab abc"), body("b.txt", "bad headache"), body("c.txt", "a far b")], DOCUMENTS).coalesce(1)
    engine = Engine.init(spark, str(base), mode="light")
    found = engine.rebuild(docs.filter("rel_path <> 'c.txt'"))
    assert found["embedded"] == "model" and found["hashed_count"] == 0
    vectors = {r["rel_path"]: r["vector"] for r in engine.bundle.live("embeddings").collect()}
    ids = w.load(f"{folder}/tokenizer.json").encode("ab abc")
    mean = table[ids[:6]].mean(axis=0)
    assert np.allclose(vectors["a.txt"], mean / np.linalg.norm(mean), atol=1e-5)
    assert engine.search("ab abc", "semantic").first()["rel_path"] == "a.txt"
    assert engine.sync(docs)["hashed_count"] == 1 and engine.bundle.manifest()["hashed_count"] == 1
    (folder / "model.onnx").rename(folder / "gone.onnx")
    with pytest.raises(ModelMismatch):
        engine.sync(docs.filter("rel_path = 'a.txt'"))
    m.open_session.cache_clear()
    with pytest.raises(Exception, match="(?i)no.?such.?file|exist"):
        engine.query_vector("ab")
    assert engine.rebuild(docs)["embedded"] == "hash" and engine.search("headache", "semantic").first()["rel_path"] == "b.txt"
    (folder / "model.onnx").write_bytes(b"no graph")
    with pytest.raises(PythonException):
        engine.rebuild(docs)
    assert engine.bundle.manifest()["embedded"] == "hash"


@given(st.lists(st.text(max_size=20), max_size=6))
@settings(max_examples=100, deadline=None)
def test_token_hashes_at_once_are_those_byte_by_byte(tokens):
    def slow(token):
        h = v.BASIS
        for b in token.encode():
            h = ((h ^ b) * ((1 << 40) + v.PRIME_LOW)) & 0xFFFFFFFFFFFFFFFF
        return h

    assert v.fnv1a(tokens).tolist() == [slow(x) for x in tokens]
