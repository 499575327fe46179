"""Embedding of chunks in requests of a fixed size, with any model; a hash embedder for tests and for exact repetition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of one request.
REQUEST = 64
#: From a list of texts to their vectors and the number of tokens that the model counted.
Embedder = Callable[[list[str]], tuple[list[list[float]], int]]


def hash_embedder(dim: int = 16) -> Embedder:
    """Vectors made of a text's hash: equal texts have equal vectors; a token is four characters."""
    import hashlib

    def embed(texts: list[str]) -> tuple[list[list[float]], int]:
        vectors = []
        for text in texts:
            digest = hashlib.shake_128(text.encode()).digest(dim)
            vectors.append([b / 127.5 - 1.0 for b in digest])
        return vectors, sum(max(1, len(t) // 4) for t in texts)

    return embed


def embedded(chunks: DataFrame, row_id: str, text: str, embedder: Embedder, request: int = REQUEST) -> DataFrame:
    """(row_id, embedding, tokens): vectors of length 1 (a zero vector as it is) of all chunks, ``request`` a call.

    ``tokens`` is what a request counted, on its first row, zero on the others, so that the column adds up. Null texts are
    empty. A request holds rows of one partition only; the last of a partition may be smaller. The embedder goes to the
    tasks, so it must be picklable; one that answers with another number of vectors is an error.
    """
    kind = chunks.schema[row_id].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def asked(some: list[tuple]) -> pa.RecordBatch:
            vectors, tokens = embedder([t or "" for _, t in some])
            if len(vectors) != len(some):
                raise ValueError(f"{len(some)} texts, {len(vectors)} vectors")
            made = []
            for vector in vectors:
                v = np.asarray(vector, np.float64)
                norm = np.sqrt((v * v).sum())
                made.append((v / norm if norm else v).astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], ids), pa.array(made, pa.list_(pa.float32())), pa.array([tokens] + [0] * (len(some) - 1), pa.int64())], [row_id, "embedding", "tokens"])

        for batch in batches:
            ids = batch.column(0).type
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(rows) >= request:
                yield asked(rows[:request])
                rows = rows[request:]
        if rows:
            yield asked(rows)

    return chunks.select(row_id, text).mapInArrow(each, f"`{row_id}` {kind}, embedding array<float>, tokens long")
