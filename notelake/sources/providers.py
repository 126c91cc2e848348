"""Embeddings of notes by a provider: a small object that turns texts into vectors inside the tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import words


class Provider(Protocol):
    """What embeds texts; name is the model's, and goes with every vector."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class Hashing:
    """Words' counts in hashed places with hashed signs, at length one: for tests and for data without a model.

    Where words of opposite signs leave nothing of a text, its words count without signs; only a text without words is zero."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hashing-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words(text)]
            for h in hashes:
                row[h % self.dimensions] += 1 if h >> 63 else -1
            if not row.any():
                for h in hashes:
                    row[h % self.dimensions] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embedded(inputs: DataFrame, provider: Provider) -> DataFrame:
    """(note_id, embedding, model) of inputs (note_id, input), a batch at a time; a null input is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = provider.embed([x or "" for x in batch.column(1).to_pylist()]).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array([provider.name] * len(vectors))], names=["note_id", "embedding", "model"])

    return inputs.select("note_id", "input").mapInArrow(run, f"note_id {dict(inputs.dtypes)['note_id']}, embedding array<float>, model string")
