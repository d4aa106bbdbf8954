"""Spelling variants of a corpus's words, found without making a pair of words for every meeting.

Words are counted inside tasks, and the vocabulary is numbered from the most frequent word down (ties in code-point order),
so the least number among a word's neighbours is its form.  Each word is then sent to

* a wildcard key for each of its positions (prefix, mark, suffix): all words of a key differ in that one place.  A key
  keeps its size and its two least numbers, which is all that any of its words needs to know of the others;
* a deletion key for each distinct result of leaving out one code point, and its own key.  A word whose own key has deletions
  of others is joined to them: it learns their number and the least of them, and each of them learns of it.

A key has no more rows than the alphabet has letters (wildcards), or that times its length (deletions), whatever the
corpus, and what leaves it is one row a member.  The rows of a word are added up: neighbours, and the least number.  Words of
more than ``LONG`` code points use 128-bit fingerprints of prefix and suffix in place of the texts, so that a word costs
its length and not its square.

Defined results: a null text has no words; a null id is read as an empty text; every row is a document, repeated rows too;
equal counts go by code-point order; very long texts are split piece by piece, very long runs are words like others; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import slices, table
from larder.llm.divergence import pieces

_OTHER = re.compile("[^\x00-\x7fÀ-ÿ]+")
#: Without other code points, bytes above 127 belong to letters.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct words that a task holds before it sends their counts; code points from which keys are fingerprints.
HELD, LONG = 400_000, 64


def _runs(text: bytes):
    """Lists of the runs of letters, A-Z in lower case."""
    if not text.isascii():
        text = _OTHER.sub(" ", text.decode()).encode()
    for piece in pieces(text.translate(_BYTES)):
        yield piece.split()


def word_counts(docs: DataFrame, min_chars: int = 7, noise: int = 31) -> DataFrame:
    """word, n of each word of min_chars or more, a row or a few for each task and word.

    A run whose crc32 with its document's id is divisible by ``noise`` has lost one code point.
    """

    def out(held: Counter) -> pa.RecordBatch:
        words = pa.array(held.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for found in _runs(text):
                    words = [w for w in found if len(w) >= min_chars]
                    held.update(words)
                    of = Counter(words)
                    for w in [w for w in of if not zlib.crc32(w, seed) % noise]:
                        whole = w.decode()
                        at = zlib.crc32(w, seed) % len(whole)
                        held[w] -= of[w]
                        held[(whole[:at] + whole[at + 1 :]).encode()] += of[w]
            if len(held) > HELD:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    doc_id, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "text"))
    return docs.select(doc_id, text).mapInArrow(run, "word string, n long").filter((F.length("word") >= min_chars) & (F.col("n") > 0))


def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2, noise: int = 31) -> DataFrame:
    """word, n and id of each word with min_count occurrences or more; the ids fall as n does, ties in code-point order."""
    words = word_counts(docs, min_chars, noise).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return table(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")


_P = (1 << 127) - 1
_BASE = 0x5DEECE66D1CE4E5B9BF58476D1CE4E5


def _keys(word: str, least: int) -> tuple[str, list[str], set[str]]:
    """The key of the word itself, its wildcard keys, and its deletion keys of least code points or more."""
    n = len(word)
    short = lambda m: m <= LONG  # noqa: E731  by the length of the word that a key stands for
    if short(n):
        return word, [f"{word[:i]}*{word[i + 1:]}" for i in range(n)], {word[:i] + word[i + 1 :] for i in range(n)} if n > least else set()
    before, after, power = [0], [0], [1]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _P)
        power.append(power[-1] * _BASE % _P)
    for k, c in enumerate(reversed(word)):
        after.append((after[-1] + ord(c) * power[k]) % _P)
    named = lambda m, h: f"{m}#{h:x}"
    rest = lambda i: after[n - 1 - i]  # noqa: E731  of what follows i
    gone = (lambda i: word[:i] + word[i + 1 :]) if short(n - 1) else (lambda i: named(n - 1, (before[i] * power[n - 1 - i] + rest(i)) % _P))
    # of equal neighbouring letters any may go; taking one of them, a word of one letter has one deletion
    places = [i for i in range(n) if not i or word[i] != word[i - 1]]
    return named(n, before[n]), [f"{n}#{i}*{before[i]:x}:{rest(i):x}" for i in range(n)], {gone(i) for i in places}


def key_rows(words: DataFrame, least: int = 1) -> DataFrame:
    """key, id, role of each word (id, word): role 0 the word itself, 1 a deletion, 2 a wildcard.

    No word has fewer than ``least`` code points, so shorter deletions are left out.
    """

    def run(batches):
        for batch in slices(batches, "word", most=1 << 18):
            keys, roles, ids = [], [], []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, masked, gone = _keys(w, least)
                keys.append(own)
                keys += masked
                keys += gone
                roles += [0, *[2] * len(masked), *[1] * len(gone)]
                ids += [i] * (1 + len(masked) + len(gone))
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(roles, pa.int8())], names=["key", "id", "role"])
                    keys, roles, ids = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(roles, pa.int8())], names=["key", "id", "role"])

    return words.select("id", "word").mapInArrow(run, "key string, id long, role byte")


def neighbours(words: DataFrame, least: int = 1) -> DataFrame:
    """id, n_near, best: how many words differ by one code point from each (those with any), and the least id of them."""
    of_key = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.col("role")
    met = key_rows(words, least).select(
        "id", "role", F.count("*").over(of_key).alias("size"), F.first("id").over(of_key).alias("least"), F.nth_value("id", 2).over(of_key).alias("second"),
        F.min(F.when(role == 0, F.col("id"))).over(of_key).alias("own"), F.min(F.when(role == 1, F.col("id"))).over(of_key).alias("longer"),
    )
    met = met.filter((F.col("size") > 1) & ((role == 2) | F.col("own").isNotNull()))
    near = F.when(role == 1, 1).otherwise(F.col("size") - 1)
    best = F.when(role == 0, F.col("longer")).when(role == 1, F.col("own")).otherwise(F.when(F.col("id") == F.col("least"), F.col("second")).otherwise(F.col("least")))
    return met.select("id", near.alias("near"), best.alias("best")).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """id, root of forms (id, form): the last word that following the forms comes to, of chains of at most ``steps``.

    Each round doubles how far a row has gone.
    """
    at = forms.select("id", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        at = table(at.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, ratio: int = 10, noise: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word.

    form: the most frequent of the words one code point away, if it occurs ratio times as often or more; root: where following
    the forms ends, the word itself if it has none.
    """
    words = vocabulary(docs, min_chars, min_count, noise)
    near = words.join(neighbours(words, min_chars), "id", "left")
    others = words.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    near = near.join(others, "best", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    near = table(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(has, F.col(c)).alias(k) for c, k in (("best", "form_id"), ("best_word", "form"), ("best_n", "form_n")))), "forms")
    most = near.agg(F.max("n")).first()[0] or 1  # one row
    steps = math.ceil(math.log(most, ratio)) + 1  # a form occurs ratio times as often
    ends = roots(near.filter("form_id is not null").select("id", F.col("form_id").alias("form")), steps)
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return near.join(ends, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
