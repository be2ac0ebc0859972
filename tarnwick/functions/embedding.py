"""Embedders: the plug-in interface and a deterministic default that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """What an embedding model must offer; ``embed`` runs in the Python workers."""

    name: str
    dimension: int
    query_prefix: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Bag of lexical terms: bucket = first 32 bits of md5(term) modulo the dimension; L2-normalised."""

    query_prefix = ""
    _term = re.compile("[a-z0-9]+")

    def __init__(self, dimension: int = 128):
        self.name, self.dimension = f"hash-bow-{dimension}", dimension
        self._bucket: dict[str, int] = {}

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        memo = self._bucket
        if len(memo) > 500_000:
            memo.clear()
        for row, text in zip(out, texts):
            for term in self._term.findall((text or "").lower()):
                b = memo.get(term)
                if b is None:
                    b = memo[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dimension
                row[b] += 1.0
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


def embed(text: Column, embedder: Embedder | None = None, batch: int = 256) -> Column:
    """Vectors of a text column as ARRAY<DOUBLE>, batch by batch in Arrow; a model loads once per worker."""
    model = embedder or HashEmbedder()

    @F.arrow_udf("array<double>")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            texts = [t or "" for t in a.to_pylist()]
            made = [np.asarray(model.embed(texts[i : i + batch]), float) for i in range(0, len(texts), batch)]
            flat = np.concatenate(made) if made else np.zeros((0, 0))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))

    return run(text)
