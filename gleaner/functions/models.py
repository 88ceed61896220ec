"""Embedding by a model's files: token ids, batches, mean pooling.  Workers open a model once.

The files are sent to the executors with the job.  A model that can't be opened there fails the job; only texts that an open
model fails on are hashed instead, and each vector says whether it was.
"""

from __future__ import annotations

import hashlib
import logging
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .catalog import Model
from .vectors import embed_text, hash_embedder
from .wordpiece import hashed_ids, load

# Names of the files of a model, texts that it is given at once, and texts that are hashed together if it fails.
MODEL_FILE, TOKENIZER_FILE, TEXTS, TOGETHER = "model.onnx", "tokenizer.json", 8, 32
log = logging.getLogger("gleaner")


def ensure_model(model: Model, folder: str, mirror: str) -> str:
    """Copy the best variant that a local mirror (folders by repository) has, and its tokenizer, unless they are there."""
    os.makedirs(folder, exist_ok=True)

    def copied(wanted: list[tuple[str, str]], name: str) -> bool:
        to = os.path.join(folder, name)
        if os.path.exists(to):
            return True
        for repository, file in wanted:
            source = os.path.join(mirror, repository, file)
            if os.path.isfile(source):
                shutil.copyfile(source, to + ".new")
                os.replace(to + ".new", to)
                return True
        return False

    best = model.best_first()
    if not copied([(r, f) for r, f, _ in best], MODEL_FILE):
        raise FileNotFoundError(f"no variant of {model.name} in {mirror}")
    copied([(r, TOKENIZER_FILE) for r, _, _ in best], TOKENIZER_FILE)  # without one, ids are hashed
    return folder


def available(folder: str) -> bool:
    return os.path.isfile(os.path.join(folder, MODEL_FILE))


def sent(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Names under which executors find a model's file and its tokenizer's ('' if there is none): one for each state of the file."""
    names = []
    for file in (MODEL_FILE, TOKENIZER_FILE):
        path = os.path.join(os.path.abspath(folder), file)
        if not os.path.isfile(path):
            names.append("")
            continue
        about = os.stat(path)
        name = f"{hashlib.sha1(f'{path}|{about.st_size}|{about.st_mtime_ns}'.encode()).hexdigest()}-{file}"
        if not os.path.exists(SparkFiles.get(name)):
            link = os.path.join(tempfile.mkdtemp(prefix="gleaner-model-"), name)
            os.symlink(path, link)
            spark.sparkContext.addFile(f"file://{link}")  # without a scheme, the name would be that of what the link points to
        names.append(name)
    return names[0], names[1]


@lru_cache(4)
def open_session(path: str):
    """An inference session on one core: Spark runs a worker for each."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def mean_pooled(states: np.ndarray, mask: np.ndarray, normalize: bool) -> np.ndarray:
    """Mean of the states that the mask counts, of unit length if asked for; zero where it counts none."""
    n = mask.sum(axis=1, keepdims=True)
    out = (states * mask[:, :, None]).sum(axis=1, dtype=np.float32) / np.maximum(n, 1)
    if normalize:
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        out = np.where(norm > 0, out / np.where(norm > 0, norm, 1), out)
    return out.astype(np.float32)


def embed_batch(session, ids: list[list[int]], dim: int, normalize: bool) -> np.ndarray:
    """Vectors of a few token lists, padded to the longest; session: get_inputs() and run() as onnxruntime's."""
    longest = max(map(len, ids), default=0)
    if not longest:
        return np.zeros((len(ids), dim), np.float32)
    tokens, mask = (np.zeros((len(ids), longest), np.int64) for _ in range(2))
    for row, own in enumerate(ids):
        tokens[row, : len(own)], mask[row, : len(own)] = own, 1
    given = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
    wanted = {x.name for x in session.get_inputs()}
    states = session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
    return mean_pooled(np.asarray(states), mask, normalize)


def embed_texts(texts: list[str], model: Model, session, tokenizer: str = "") -> tuple[list[np.ndarray], list[bool]]:
    """Vectors of texts by an open session, and which are hashed because it failed on their batch; tokenizer: its file, '' for hashed ids."""
    encode = load(tokenizer).encode if tokenizer else hashed_ids
    out: list[np.ndarray] = []
    hashed: list[bool] = []
    for k in range(0, len(texts), TOGETHER):
        some = texts[k : k + TOGETHER]
        ids = [encode(t)[: model.max_tokens] for t in some]
        try:
            parts = [embed_batch(session, ids[i : i + TEXTS], model.dimension, model.normalize) for i in range(0, len(ids), TEXTS)]
            out += [v for part in parts for v in part]
            hashed += [False] * len(some)
        except Exception as e:  # whatever the runtime raises for these texts
            log.warning("the model failed on %d texts, which are hashed: %s", len(some), e)
            out += [embed_text(t, model.dimension, model.normalize) for t in some]
            hashed += [True] * len(some)
    return out, hashed


def embed_here(text: str, model: Model, folder: str) -> np.ndarray:
    """The vector of one text by the model's files on this machine."""
    tokenizer = os.path.join(folder, TOKENIZER_FILE)
    session = open_session(os.path.join(folder, MODEL_FILE))
    vectors, hashed = embed_texts([text], model, session, tokenizer if os.path.isfile(tokenizer) else "")
    if hashed[0]:
        raise RuntimeError(f"{model.name} failed on the text")
    return vectors[0]


def embedder(model: Model, spark: SparkSession | None = None, folder: str | None = None, opened: Callable = open_session) -> Callable[[Column], Column]:
    """Expression text -> struct(vector, hashed): the model's vectors, or hashed words if no folder is given (those don't count as hashed)."""
    if folder is None:
        return lambda text: F.struct(hash_embedder(model.dimension, model.normalize)(text).alias("vector"), F.lit(False).alias("hashed"))
    name, tokenizer = sent(spark, folder)
    if not name:
        raise FileNotFoundError(f"no {MODEL_FILE} in {folder}")

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        session = opened(SparkFiles.get(name))
        for s in batches:
            vectors, hashed = embed_texts(s.fillna("").tolist(), model, session, SparkFiles.get(tokenizer) if tokenizer else "")
            yield pd.DataFrame({"vector": vectors, "hashed": hashed})

    return F.pandas_udf(embed, "vector array<float>, hashed boolean")
