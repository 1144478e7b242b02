"""Settings with the defaults of every plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache

#: Fusion weights of the dense list by configuration; an unknown one counts as hybrid.
ALPHAS = {"dense": 1.0, "hybrid": 0.5, "hybrid+hyde": 0.5}


@dataclass(frozen=True)
class Settings:
    retrieval_top_k: int = 10
    hybrid_alpha: float = 0.5
    fetch_multiplier: int = 3
    rrf_k: int = 60
    reranker_enabled: bool = True
    reranker_candidates: int = 50
    hyde_enabled: bool = False
    hyde_min_tokens: int = 5
    hyde_max_chars: int = 2000
    candidate_k: int = 10
    technique_depth: int = 300
    actor_depth: int = 40
    generation_max_tokens: int = 1024
    llm_provider: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.hybrid_alpha <= 1:
            raise ValueError("hybrid_alpha must be within 0 and 1")
        if self.hyde_enabled and not self.llm_provider:
            raise ValueError("a query rewriter needs a language model")


def alpha(config: str) -> float:
    return ALPHAS.get(config, 0.5)


def from_environment(prefix: str = "FATHOM_") -> Settings:
    """Settings from variables such as FATHOM_RETRIEVAL_TOP_K; the defaults where they are unset."""
    found = {}
    for f in fields(Settings):
        if (raw := os.environ.get(prefix + f.name.upper())) is not None:
            kind = type(f.default)
            found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return Settings(**found)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    return from_environment()
