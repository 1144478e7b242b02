"""Model columns: embedders, scorers and language models are functions that a plan is given; these are the offline stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import word_count

#: A text column to a vector column; (query, content) to a score; a prompt to an answer, null where the model failed.
Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]
Writer = Callable[[Column], Column]

#: Fixed value: the model with a short name.
ALIASES = {"bge-m3": "BAAI/bge-m3"}
FAILED = "[generation failed]"
#: What the models are told.
ANSWER_PROMPT = "Answer from the given context only. Put the id of every chunk you rely on in square brackets."
TECHNIQUE_PROMPT = "List the ids of the techniques that the text describes, chosen from the candidates, one a line."
ACTOR_PROMPT = "Name the one threat actor that the text describes, from the candidates if one fits; write NONE if none does."
REWRITE_PROMPT = "Write a short passage that a report answering this question would contain."


def model_name(name: str) -> str:
    return ALIASES.get(name.strip(), name.strip())


TASKS = ("rewrite", "analysis", "report")


def routed(task: str, models: dict[str, str], provider: str = "", local: str = "") -> str:
    """The model for a task: the local one for all if there is one, else a provider's single model (``models[provider]``), else the task's own."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    return local or models.get(provider) or models[task]


def batch_scorer(score: Callable[[list[str], list[str]], list[float]], batch: int = 8, longest: int = 512) -> Scorer:
    """A scorer of pairs that runs on the executors: a model function gets ``batch`` pairs at a time, contents cut to ``longest`` words."""

    @F.pandas_udf("double")
    def scored(queries: pd.Series, contents: pd.Series) -> pd.Series:
        cut = [" ".join((c or "").split()[:longest]) for c in contents]
        out: list[float] = []
        for low in range(0, len(cut), batch):
            out += score([q or "" for q in queries[low : low + batch]], cut[low : low + batch])
        return pd.Series(out, dtype=float)

    return scored


def batch_writer(write: Callable[[str], str], tries: int = 3, wait: float = 2.0) -> Writer:
    """A language model that runs on the executors: a prompt is tried again, waiting longer each time, and null where all tries fail."""

    @F.pandas_udf("string")
    def written(prompts: pd.Series) -> pd.Series:
        import time

        def one(prompt: str | None) -> str | None:
            for n in range(tries):
                try:
                    return None if prompt is None else write(prompt)
                except Exception:  # noqa: BLE001  any client, any fault
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
            return None

        return prompts.map(one)

    return written


def hashed_vector(dim: int = 64) -> Embedder:
    """A unit vector of hashed words: each word adds 1 or -1 at a place that its hash picks. Blank text gives zeros."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for text in s:
                v = np.zeros(dim)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 16 & 1 else -1
                size = np.linalg.norm(v)
                out.append((v / size if size else v).astype(np.float32))
            yield pd.Series(out)

    return embed


def no_model(prompt: Column) -> Column:
    """A language model that is not there: every call fails."""
    return F.lit(None).cast("string")


def dense_text(text: Column, writer: Writer | None, min_tokens: int = 5, max_chars: int = 2000) -> Column:
    """The text to embed: a written passage for queries of ``min_tokens`` words or more, the query itself where the model is off or fails."""
    if writer is None:
        return text
    made = F.substring(writer(F.concat(F.lit(REWRITE_PROMPT + "\n\n"), text)), 1, max_chars)
    return F.when(word_count(text) >= min_tokens, F.coalesce(F.nullif(F.trim(made), F.lit("")), text)).otherwise(text)


def pick_provider(ollama: str = "", groq: str = "", anthropic: str = "") -> str:
    """The first configured provider in order of preference."""
    for name, key in (("ollama", ollama), ("groq", groq), ("anthropic", anthropic)):
        if key:
            return name
    raise ValueError("no language model is configured")
