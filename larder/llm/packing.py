"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are the binary digits of their
number (with as many full sequences of ``limit`` as fit).  Each piece is a sequence by
itself: equal lengths share a bucket, batches are drawn from one bucket, no sequence
crosses documents and nothing is padded.

Defined results: a null or empty text gives one piece with the end token; repeated rows
are packed each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut, slices

def binary_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then falling powers of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


#: Anything but Latin letters, white space and lone full stops and commas.
_NOT_SIMPLE = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ \n\t\r.,]|[.,][.,]")
#: Anything that Python's regex may take apart in another way than the tokenizer's pattern.
_NOT_PLAIN = re.compile(r"[^ \n\t\r!-~À-ÿ‐-‧]|<\|")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)} | {32: 32}


class WordTokens:
    """Ids of texts, word by word.

    The tokenizer's pattern cuts a plain text into words and runs of signs, each encoded by itself;
    known ones are looked up.  New ones go to the tokenizer's own model, joined by spaces and cut
    again at its word ends, which spares the normalizer.  Texts with signs that Python's regex may see in
    another way go to the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            text = " ".join(part)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer's model does not end words as expected")
            data, ends = ids.tobytes(), (ends * 4).tolist()
            self.words.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))

    @staticmethod
    def _split(text: str) -> list[str] | None:
        if not _NOT_SIMPLE.search(text):
            return text.lower().replace(".", " . ").replace(",", " , ").split()
        return None if _NOT_PLAIN.search(text) else _WORDS.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        gc.disable()  # millions of strings without cycles: collections only cost time
        try:
            out = []
            for at in range(0, len(texts), 200):
                split = [self._split(t) for t in texts[at : at + 200]]
                if len(self.words) > self.most:
                    self.words = {}
                seen = set().union(*(s for s in split if s))
                new = seen.difference(self.words)
                plain = [w for w in new if w.isascii()]
                self._learn(plain)
                if len(plain) < len(new):
                    self._learn([w for w in new if not w.isascii()])
                look = self.words.__getitem__
                out += [self._whole(t) if s is None else b"".join(map(look, s)) for t, s in zip(texts[at : at + 200], split)]
            return out
        finally:
            gc.enable()


_TOKENS: dict[str, WordTokens] = {}


def decompose(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens and, with keep_ids, ids.

    No shuffle; memory is bounded by a batch of texts and the table of known words.
    """
    binary_lengths(0, limit)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _TOKENS.get(tokenizer) or _TOKENS.setdefault(tokenizer, WordTokens(tokenizer))
        for batch in slices(batches):
            out = {k: [] for k, _ in fields}
            ids = batch.column(0).to_pylist()
            for doc, data in zip(ids, tokens.encode([t or "" for t in batch.column(1).to_pylist()])):
                data += end
                at, n = 0, len(data) // 4
                for size in binary_lengths(n, limit):
                    part = data[4 * at : 4 * (at + size)]
                    for k, v in zip(out, (doc, at, size, zlib.crc32(part), n)):
                        out[k].append(v)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<i4"))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in fields], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ddl(fields))


def _ddl(fields) -> str:
    names = {pa.int64(): "long", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{k} {names[t]}" for k, t in fields)


def assign_sequences(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id (gapless, bucket after bucket from the longest) and offset to pieces.

    The pieces are checkpointed; what reaches the driver is a count for each partition and
    bucket length.
    """
    pieces = cut(pieces)
    counts = pieces.groupBy(F.spark_partition_id().alias("pid"), "length").count().collect()
    base, at = {}, 0
    for r in sorted(counts, key=lambda r: (-r["length"], r["pid"])):
        base[r["pid"], r["length"]] = at
        at += r["count"]

    def run(batches):
        pid = TaskContext.get().partitionId()
        upto = {n: at for (p, n), at in base.items() if p == pid}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ids = np.empty(len(lengths), dtype=np.int64)
            for n in np.unique(lengths):
                here = np.flatnonzero(lengths == n)
                ids[here] = upto[int(n)] + np.arange(len(here))
                upto[int(n)] += len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array(np.zeros(len(ids), dtype=np.int64))], names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in pieces.dtypes)
    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return assign_sequences(decompose(docs, tokenizer, limit, end_id, keep_ids))
