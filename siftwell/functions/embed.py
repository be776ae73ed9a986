"""Embedding providers: named functions from texts to vectors, applied in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]
_PROVIDERS: dict[str, Callable[[], Embedder]] = {}


def register(name: str):
    """Registers a factory; it runs once in each worker that embeds, so that models load there."""

    def wrap(factory: Callable[[], Embedder]) -> Callable[[], Embedder]:
        _PROVIDERS[name] = factory
        return factory

    return wrap


def available() -> list[str]:
    return sorted(_PROVIDERS)


def provider(name: str) -> Callable[[], Embedder]:
    if name not in _PROVIDERS:
        raise ValueError(f"no embedder {name}; there are {', '.join(available())}")
    return _PROVIDERS[name]


def hashing(dim: int = 64) -> Embedder:
    """Signed hashed counts of words and word pairs: deterministic, and near for texts that share words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return embed


register("hashing_64")(lambda: hashing(64))
register("hashing_256")(lambda: hashing(256))


def embed(df: DataFrame, text: str, into: str, name: str, normalize: bool = True) -> DataFrame:
    """df with the vectors of a text column; null texts count as empty, zero vectors stay zero."""
    factory = provider(name)
    schema = T.StructType([f for f in df.schema.fields if f.name != into] + [T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            vectors = model(frame[text].fillna("").tolist()) if len(frame) else np.zeros((0, 1))
            if normalize:
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(size == 0, 1.0, size)
            yield frame.drop(columns=[into], errors="ignore").assign(**{into: list(vectors.astype(np.float32))})

    return df.mapInPandas(run, schema)


def embed_once(df: DataFrame, text: str, into: str, name: str, normalize: bool = True) -> DataFrame:
    """As embed, but each distinct text is embedded once."""
    return df.join(embed(df.select(text).distinct(), text, into, name, normalize), text, "left")
