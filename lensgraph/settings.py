"""Settings of encoders and scorers, from defaults, the environment and arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

LEAST_DIMENSION, MOST_DIMENSION = 128, 4096


@dataclass(frozen=True)
class Settings:
    """Bounds are checked on construction. Environment variables are PREFIX plus the upper-cased name."""

    model_id: str = "hashing-encoder"
    scorer_id: str = "overlap-scorer"
    dimension: int = 4096
    batch_size: int = 8
    max_length: int = 8192
    normalize: bool = True
    most_texts: int = 20
    most_pairs: int = 100
    top_k: int = 10

    def __post_init__(self):
        if not LEAST_DIMENSION <= self.dimension <= MOST_DIMENSION:
            raise ValueError(f"dimension must be {LEAST_DIMENSION} to {MOST_DIMENSION}, not {self.dimension}")
        for name in ("batch_size", "max_length", "most_texts", "most_pairs", "top_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def from_env(cls, prefix: str = "LENSGRAPH_", **given) -> Settings:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**(found | given))
