"""Embedders and the operator that embeds text columns."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.schema import EngineConfig

MAX_CHARS = 8000
SHORTER = (8000, 4000, 2000, 500)
DOCUMENT, QUERY = "search_document: ", "search_query: "


class Embedder(Protocol):
    name: str
    dimension: int
    batch_size: int
    char_budget: int
    prefixed: bool
    max_chars: int | None  # characters of a text that are embedded; None: all
    concurrency: int | None  # callers at once; None: any number

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashingEmbedder:
    """Deterministic unit vectors without a model: signed feature hashing of words and word pairs."""

    dimension: int = 768
    batch_size: int = 200
    char_budget: int = 1_000_000
    name: str = "hashing"
    prefixed: bool = False
    max_chars: int | None = None
    concurrency: int | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            words = text.lower().split()
            v = np.zeros(self.dimension)
            for term in [*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))]:
                h = zlib.crc32(term.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            if not v.any():
                v[zlib.crc32(text.encode()) % self.dimension] = 1.0
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out


@dataclass
class HttpEmbedder:
    """A local (/api/embed) or remote (/v1/embeddings) embedding service."""

    base_url: str
    model: str
    api_key: str | None = None
    remote: bool = False
    dimension: int = 768
    batch_size: int = 50
    concurrency: int = 2
    max_chars: int = MAX_CHARS
    timeout: float = 120.0

    @property
    def name(self) -> str:
        return "remote" if self.remote else "local"

    @property
    def prefixed(self) -> bool:
        return not self.remote

    @property
    def char_budget(self) -> int:
        return 300_000 if self.remote else 150_000

    def _call(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.remote:
            found = self._call("/v1/embeddings", {"model": self.model, "input": texts})["data"]
            return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]
        return self._call("/api/embed", {"model": self.model, "input": texts})["embeddings"]

    def healthy(self) -> bool:
        try:
            if self.remote:
                return len(self.embed(["ping"])) == 1
            return any(m.get("name", "").split(":")[0] == self.model.split(":")[0] for m in self._call("/api/tags").get("models", []))
        except (OSError, ValueError, KeyError):
            return False

    def probe_dimension(self) -> int:
        self.dimension = len(self.embed(["dimension probe"])[0])
        return self.dimension


def create_embedder(config: EngineConfig) -> Embedder:
    if config.embedding_provider == "hashing":
        return HashingEmbedder(config.embedding_dimension)
    if config.embedding_provider in ("local", "ollama"):
        return HttpEmbedder(config.embedding_base_url or "http://localhost:11434", config.embedding_model, dimension=config.embedding_dimension, batch_size=config.embedding_batch_size, concurrency=config.embedding_concurrency)
    if config.embedding_provider in ("remote", "openai"):
        return HttpEmbedder(config.embedding_base_url or "https://api.openai.com", config.embedding_model, config.embedding_api_key, True, config.embedding_dimension, config.embedding_batch_size, config.embedding_concurrency)
    raise ValueError(f"unknown embedding provider: {config.embedding_provider}")


def batches(texts: list[str], size: int, budget: int):
    """Runs of at most ``size`` texts and ``budget`` characters, one text at least."""
    run: list[str] = []
    total = 0
    for t in texts:
        if run and (len(run) >= size or total + len(t) > budget):
            yield run
            run, total = [], 0
        run.append(t)
        total += len(t)
    if run:
        yield run


def embed_or_split(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """Embeds a batch; on failure its halves, and a single text ever shorter, at last as a zero vector."""
    try:
        got = embedder.embed(texts)
        if len(got) == len(texts):
            return got
    except Exception:  # noqa: BLE001 - a service may fail in any way
        pass
    if len(texts) > 1:
        half = len(texts) // 2
        return embed_or_split(embedder, texts[:half]) + embed_or_split(embedder, texts[half:])
    for n in SHORTER:
        if n < len(texts[0]) or n == SHORTER[-1]:
            try:
                return embedder.embed([texts[0][:n]])
            except Exception:  # noqa: BLE001
                continue
    return [[0.0] * embedder.dimension]


def _most(embedder: Embedder) -> int | None:
    """What a service takes of a text; one that doesn't say takes MAX_CHARS."""
    return getattr(embedder, "max_chars", MAX_CHARS)


def embed_texts(embedder: Embedder, texts: list[str], prefix: str = DOCUMENT) -> list[list[float]]:
    given = [((prefix if embedder.prefixed else "") + (t or ""))[: _most(embedder)] for t in texts]
    return [v for run in batches(given, embedder.batch_size, embedder.char_budget) for v in embed_or_split(embedder, run)]


def embed_query(embedder: Embedder, text: str, prefix: str = QUERY) -> list[float]:
    return embed_or_split(embedder, [((prefix if embedder.prefixed else "") + text)[: _most(embedder)]])[0]


def with_vectors(df: DataFrame, text_col: str, embedder: Embedder, prefix: str = DOCUMENT) -> DataFrame:
    """df with the column vector: the rows' texts embedded in Arrow batches, next to the rows.

    A service that bounds its callers is asked from at most so many tasks at once.
    """
    callers = getattr(embedder, "concurrency", None)
    if callers:
        df = df.coalesce(callers)
    return df.withColumn("vector", _series_udf(embedder, prefix)(F.col(text_col)))


def _series_udf(embedder: Embedder, prefix: str):
    def vectors(texts):
        return pd.Series(embed_texts(embedder, texts.fillna("").tolist(), prefix))

    vectors.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(vectors, T.ArrayType(T.FloatType()))
