"""What Python holds at once must not grow with a batch or a partition."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import vectors as v
from gleaner.functions import wordpiece as w
from gleaner.plans import engine_queries as q
from gleaner.sources.shared import BATCH_BYTES

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (5, 0, 70, 300, 1, 2, 90, 40)] + [None, "b"]
    parts = list(v.slices(texts, 200))
    assert sum(parts, []) == texts and list(v.slices([])) == []
    assert all(len(p) == 1 or sum(len(t or "") + 32 for t in p) <= 232 for p in parts) and len(parts) > 3


def test_batches_of_documents_to_word_pieces_are_bounded(spark, sf):
    session = spark.newSession()
    session.conf.unset(BOUND)
    assert q.wordpiece_ids(session, sf).count() > 0
    assert session.conf.get(BOUND) == str(BATCH_BYTES)


@pytest.mark.parametrize("head", ["##", "_"])
def test_remembered_words_have_the_ids_of_their_pieces(head, monkeypatch):
    monkeypatch.setattr(w, "REMEMBERED", 7)
    vocabulary = {"a": 5, "ab": 6, "abc": 7, "é": 8, f"{head}b": 9, f"{head}bcd": 10, f"{head}c": 11, ".": 12}
    piece = w.WordPiece.of(json.dumps({"model": {"type": "WordPiece", "vocab": vocabulary, "continuing_subword_prefix": head}}))
    text = " ".join(["abc", "abcd", "abbcd", "ab", "xyz", "a.b", "É", "a" * 101, *[f"ab{'c' * k}" for k in range(12)], "abc"])
    want = [i for word in w.pre_tokenize(w.plain(text)) for i in piece.pieces(word)]
    assert piece.encode(text)[1:-1] == want and piece.encode_array(text).tolist() == piece.encode(text) and len(piece._known) <= 7
    assert piece.pieces("abbcd") == [6, 10] and piece.pieces("abcc") == [7, 11] and piece.pieces("ba") == [100]


def test_hashing_words_holds_a_slice_only():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 150)) for _ in range(3000)]
    v.embed_texts(texts[:2], 8)  # tables of characters
    assert peak_mb(lambda: v.embed_texts(texts, 8)) < 120
