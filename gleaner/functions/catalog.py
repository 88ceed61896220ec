"""Embedding modes."""

from __future__ import annotations

import platform
from dataclasses import dataclass

# The prefix and the modes' models, sizes and files.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


@dataclass(frozen=True)
class Model:
    mode: str
    name: str
    dimension: int
    max_tokens: int
    size_mb: int
    query_prefix: str = ""
    document_prefix: str = ""
    normalize: bool = True
    #: (repository, file, priority), and those for processors of the ARM architecture only
    variants: tuple[tuple[str, str, int], ...] = ()
    arm_variants: tuple[tuple[str, str, int], ...] = ()

    def best_first(self, machine: str | None = None) -> list[tuple[str, str, int]]:
        arm = (machine or platform.machine()).lower() in ("arm64", "aarch64")
        return sorted((*self.variants, *(self.arm_variants if arm else ())), key=lambda v: -v[2])


MODELS = {
    m.mode: m
    for m in (
        Model("light", "all-MiniLM-L6-v2", 384, 256, 23, variants=(("sentence-transformers/all-MiniLM-L6-v2", "onnx/model_O4.onnx", 90), ("sentence-transformers/all-MiniLM-L6-v2", "onnx/model_O3.onnx", 80), ("sentence-transformers/all-MiniLM-L6-v2", "onnx/model_O2.onnx", 70), ("sentence-transformers/all-MiniLM-L6-v2", "onnx/model.onnx", 10)), arm_variants=(("sentence-transformers/all-MiniLM-L6-v2", "onnx/model_qint8_arm64.onnx", 100),)),
        Model("balanced", "bge-small-en-v1.5", 384, 512, 33, QUERY_PREFIX, variants=(("Qdrant/bge-small-en-v1.5-onnx-Q", "model_qint8.onnx", 100), ("BAAI/bge-small-en-v1.5", "onnx/model.onnx", 10))),
        Model("quality", "bge-base-en-v1.5", 768, 512, 218, QUERY_PREFIX, variants=(("Qdrant/bge-base-en-v1.5-onnx-Q", "model_optimized.onnx", 100), ("BAAI/bge-base-en-v1.5", "onnx/model.onnx", 10))),
        Model("nomic", "nomic-embed-text-v1", 768, 2048, 550, variants=(("nomic-ai/nomic-embed-text-v1", "onnx/model.onnx", 10),)),
    )
}
