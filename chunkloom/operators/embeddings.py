"""Embedding providers by name; each turns a text column into an array of floats in Arrow batches."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from chunkloom.config import Embeddings
from chunkloom.errors import EmbeddingError, MissingDependency
from chunkloom.functions import udfs as U

Provider = Callable[[Embeddings], Callable[[Column], Column]]
_PROVIDERS: dict[str, Provider] = {}


def register_provider(name: str, provider: Provider) -> None:
    _PROVIDERS[name] = provider


def available_providers() -> list[str]:
    return sorted(_PROVIDERS)


def _batched(embed: Callable[[list[str]], list[list[float]]], size: int) -> Callable[[Column], Column]:
    @pandas_udf(ArrayType(FloatType()))
    def run(text: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        texts = text.fillna("").tolist()
        for i in range(0, len(texts), size):
            got = embed(texts[i : i + size])
            if len(got) != len(texts[i : i + size]):
                raise EmbeddingError(f"{len(got)} vectors for {len(texts[i : i + size])} texts")
            out += got
        return pd.Series(out)

    return run


def _post(url: str, body: dict, key: str = "") -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return json.load(r)
    except OSError as e:
        raise EmbeddingError(f"{url}: {e}") from e


def _sentence_transformers(cfg: Embeddings):
    def embed(texts: list[str]) -> list[list[float]]:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise MissingDependency("sentence-transformers is needed for this provider") from e
        return SentenceTransformer(cfg.model).encode(texts, normalize_embeddings=True).tolist()

    return _batched(embed, cfg.batch_size)


def _ollama(cfg: Embeddings):
    return _batched(lambda texts: [_post(f"{cfg.base_url}/api/embeddings", {"model": cfg.model, "prompt": t})["embedding"] for t in texts], cfg.batch_size)


def _compatible(cfg: Embeddings):
    def embed(texts: list[str]) -> list[list[float]]:
        data = _post(f"{cfg.base_url}/embeddings", {"model": cfg.model, "input": texts}, os.environ.get(cfg.api_key_env, ""))["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return _batched(embed, cfg.batch_size)


register_provider("hash", lambda cfg: lambda text: U.hash_embedding(text, cfg.dimensions))
register_provider("sentence-transformers", _sentence_transformers)
register_provider("ollama", _ollama)
register_provider("openai-compatible", _compatible)


def embedding_text(prefix: bool = True) -> Column:
    """What is embedded of a chunk: its context prefix, where it has one, and its content."""
    head = F.nullif("context_prefix", F.lit("")) if prefix else F.lit(None).cast("string")
    return F.concat_ws("\n\n", head, "content")


def embed_chunks(chunks: DataFrame, cfg: Embeddings) -> DataFrame:
    if cfg.provider not in _PROVIDERS:
        raise EmbeddingError(f"unknown provider {cfg.provider}", hint=", ".join(available_providers()))
    return chunks.withColumn("embedding", _PROVIDERS[cfg.provider](cfg)(embedding_text(cfg.embed_context_prefix and "context_prefix" in chunks.columns)))
