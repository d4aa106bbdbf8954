"""Batch embedding with an injected provider; vectors come out L2-normalized."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """The default provider: signed word hashing, the same on every machine."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    return out


def normalized(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norm == 0, 1, norm)).astype(np.float32)


def embed(chunks: DataFrame, keys: list[str], text: str, model: str, dim: int, provider: Provider | None = None, batch: int = 100, skip_failures: bool = False) -> DataFrame:
    """keys, model, dim and embedding of each text; the provider is called with ``batch`` texts at a time.

    A task reads the texts of one call at a time and gives its vectors on after each call, whatever the size of Spark's batches.
    Rows are paired by key, never by position.  A provider that answers with another dimension fails the task.  With
    skip_failures a call that fails is made again text by text, and a text that fails alone has a null embedding.
    """
    call = provider or (lambda texts: hashed_words(texts, dim))
    kinds = dict(chunks.dtypes)

    def asked(texts: list[str], failed: list[bool]) -> np.ndarray:
        try:
            found = np.asarray(call(texts), dtype=np.float32)
        except Exception:
            if not skip_failures:
                raise
            if len(texts) > 1:
                return np.concatenate([asked([t], failed) for t in texts])
            failed.append(True)
            return np.zeros((1, dim), np.float32)
        if found.shape != (len(texts), dim):
            raise ValueError(f"the provider gave {found.shape}, not {(len(texts), dim)}")
        failed += [False] * len(texts)
        return found

    def run(batches):
        for b in (whole.slice(i, batch) for whole in batches for i in range(0, whole.num_rows, batch)):
            texts, failed = [t or "" for t in b.column(len(keys)).to_pylist()], []
            m = normalized(asked(texts, failed))
            n = len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([model] * n, pa.string()), pa.array([dim] * n, pa.int32()), pa.array([None if bad else v for v, bad in zip(m, failed)], pa.list_(pa.float32()))], names=[*keys, "model", "dim", "embedding"])

    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", model string, dim int, embedding array<float>"
    return chunks.select(*keys, F.col(text)).mapInArrow(run, ddl)
