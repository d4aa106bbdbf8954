"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.batches import slices  # noqa: F401  the operators find it here


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/larder-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: its partitions stay as they are, in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: compact, and the lineage ends."""
    path = f"{checkpoint_root(df.sparkSession)}/larder/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_NOT_WORD = re.compile(r"[\W_]+")


def bare(chunk: str) -> str:
    """A chunk without punctuation."""
    return _NOT_WORD.sub("", chunk)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole text when it has fewer (none: empty)."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += words[i : len(words) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def held_out(doc_id="doc_id"):
    """Rows kept from training: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
