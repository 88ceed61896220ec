"""Configuration: defaults, TOML file, environment, validation."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, replace

from ..functions.catalog import MODELS
from ..operators.chunking import Chunking
from ..sources.scan import IGNORED, Source

NAME = re.compile(r"^[a-zA-Z0-9._ -]+$")
ENV = "GLEANER_"


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    base_dir: str
    mode: str = "balanced"
    bundle: str = "default"
    chunking: Chunking = field(default_factory=Chunking)
    ignore: tuple[str, ...] = IGNORED
    use_gitignore: bool = True
    sources: list[Source] = field(default_factory=list)

    @property
    def bundle_path(self) -> str:
        return os.path.join(self.base_dir, "bundles", self.bundle)

    @property
    def file(self) -> str:
        return os.path.join(self.base_dir, "config.toml")

    def validate(self) -> Config:
        c = self.chunking
        names = [s.name for s in self.sources]
        rules = [
            (self.bundle.strip(), "the bundle needs a name"),
            (self.mode in MODELS, f"the mode must be one of {', '.join(MODELS)}"),
            (os.path.isabs(self.base_dir), "the base directory must be absolute"),
            (c.min_chars <= c.max_chars, "min_chars must not exceed max_chars"),
            (c.overlap_chars < c.max_chars, "overlap_chars must be less than max_chars"),
            (all(NAME.match(n) and n.strip() for n in names), "names of sources hold letters, numbers, dots, underscores, dashes and spaces"),
            (len(set(names)) == len(names), "names of sources must differ"),
            (all(os.path.isabs(s.path) for s in self.sources), "paths of sources must be absolute"),
        ]
        for ok, what in rules:
            if not ok:
                raise ConfigError(what)
        return self

    def save(self) -> None:
        self.validate()
        os.makedirs(self.base_dir, exist_ok=True)
        text = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else "[" + ", ".join(map(text, x)) + "]" if isinstance(x, (list, tuple)) else str(x)
        lines = [f"{k} = {text(getattr(self, k))}" for k in ("mode", "bundle", "ignore", "use_gitignore")]
        lines += ["", "[chunking]", *[f"{k} = {text(v)}" for k, v in asdict(self.chunking).items()]]
        for s in self.sources:
            lines += ["", "[[sources]]", *[f"{k} = {text(v)}" for k, v in asdict(s).items()]]
        with open(self.file + ".new", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        os.replace(self.file + ".new", self.file)

    @classmethod
    def load(cls, base_dir: str) -> Config:
        path = os.path.join(base_dir, "config.toml")
        if not os.path.exists(path):
            raise ConfigError("not initialized")
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        chunking = replace(Chunking(), **raw.get("chunking", {}))
        out = cls(base_dir, raw.get("mode", "balanced"), raw.get("bundle", "default"), chunking, tuple(raw.get("ignore", IGNORED)), raw.get("use_gitignore", True), [Source(**s) for s in raw.get("sources", [])])
        for name in ("mode", "bundle"):
            setattr(out, name, os.environ.get(ENV + name.upper(), getattr(out, name)))
        return out.validate()
