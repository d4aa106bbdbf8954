"""The training-data operators on small inputs: brute force, round trips, held-out accuracy, awkward rows."""

import hashlib
import io
import itertools
import math
import random
import string
import textwrap
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import audio, chat, components, decontaminate, jaccard, licences, lines, packing, queries, sharding, toxicity, warc
from larder.llm.common import bare, checkpoint_root
from larder.llm.wordhash import WordArrays
from tests.conftest import SF
from tests.oracle import connection, same

DOCS = "doc_id long, text string, score string, n_lines int, size string, node string, _id int, shard int"
#: Nulls anywhere, empty and long texts, ties, repeated rows, extra columns with the operators' own names.
AWKWARD = [
    (1, "one two three four five six seven", "x", 1, "s", "n", 1, 1), (1, "one two three four five six seven", "x", 1, "s", "n", 1, 1),
    (2, None, None, None, None, None, None, None), (None, "lone text", "y", 2, "s", "n", 2, 2), (None, None, None, None, None, None, None, None),
    (3, "", "z", 3, "", "", 3, 3), (4, "word " * 30_000, "w", 4, "s", "n", 4, 4), (5, "a\n\nb\na\n  A  ", "v", 5, "s", "n", 5, 5), (2, "other text of a known id", "u", 6, "s", "n", 6, 6),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_awkward_rows_and_empty_tables(spark, awkward, empty):
    n = len(AWKWARD)
    tokenizer = queries.tokenizer_path()
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "three four five six seven"), (2, None), (3, ""), (4, "hi")], "item_id long, text string")
    model = toxicity.train(awkward, labels)
    runs = {
        "toxicity": lambda d: toxicity.score(d, model), "shards": lambda d: sharding.shard_by_bytes(d, 5), "lines": lambda d: lines.dedup_lines(d, 2), "lines none": lambda d: lines.dedup_lines(d, 2, 1, "none"),
        "media": lambda d: audio.media_features(d, f"{checkpoint_root(spark)}/tensors-{uuid.uuid4().hex}"), "classes": lambda d: jaccard.jaccard_classes(d), "licences": lambda d: licences.scan(d, licences.fit(["plain text"], each=8, steps=5)),
    }
    for name, run in runs.items():
        assert run(awkward).count() == n, name
        assert run(empty).count() == 0, name
    assert packing.pack(empty, tokenizer).count() == 0
    assert packing.pack(awkward, tokenizer, keep_ids=False).select("doc_id").distinct().count() == 6
    assert jaccard.keep_one(awkward).count() == 6  # the copies of row 1, and of the empty text (four rows), are one each
    assert jaccard.keep_one(empty).count() == 0
    leaks = decontaminate.find_leaks(awkward, bench)
    assert Counter((r["doc_id"], r["item_id"]) for r in leaks.collect()) == {(1, 1): 2}
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(awkward, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaking(awkward, bench).count() == n - 2
    assert set(toxicity.score(awkward, model).columns) == {*awkward.columns, "predicted"}


def test_toxicity_held_out(spark):
    """Learned from positives and unlabelled texts: held-out words are told apart."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        rows.append((i, " ".join(rng.choices(words, k=40) + (rng.sample(["bad1", "bad2", "bad3", "bad4"], 3) if toxic else []))))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 8 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_of_words_that_are_only_more_frequent(spark):
    """No word is a toxic text's own: 60 of 400 words are three times as frequent there, and a fifth of the unlabelled texts are toxic."""
    rng = random.Random(3)
    words = [f"w{i:03d}x" for i in range(400)]
    text = lambda toxic: " ".join(rng.choices(words, [3 if toxic and i < 60 else 1 for i in range(400)], k=60))
    texts = [text(True) for _ in range(1000)] + [text(rng.random() < 0.2) for _ in range(3750)] + [text(i % 5 == 0) for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(docs.filter("doc_id < 4750"), spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id long, toxic int"), prior=0.2)
    scores = [r["score"] for r in toxicity.score(docs.filter("doc_id >= 4750"), model).orderBy("doc_id").collect()]
    bad, good = scores[::5], [s for i, s in enumerate(scores) if i % 5]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) >= 0.95 * len(bad) * len(good)


def test_toxicity_features_against_plain_code(spark):
    """The chosen features are those that loops over the sample choose; copies of a positive count once, whatever a text's length."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda lean: " ".join(rng.choices(words, [lean if i < 12 else 1 for i in range(60)], k=rng.randint(5, 25)))
    copied = " ".join(f"copied{i}" for i in range(30))
    pos = [text(4) for _ in range(80)] + [copied] * 20
    unl = [text(1) for _ in range(200)] + [" ".join(words * 4000)]
    rows = [(i, True, toxicity._buckets(t)) for i, t in enumerate(pos)] + [(i, False, toxicity._buckets(t)) for i, t in enumerate(unl)]
    made = spark.createDataFrame([(i, s, toxicity._sketch(b).tolist() if s else None, b.tolist()) for i, s, b in rows], "doc_id long, positive boolean, sketch array<int>, buckets array<int>")
    of_pos, of_unl = Counter(b for _, s, f in rows if s for b in f.tolist()), Counter(b for _, s, f in rows if not s for b in f.tolist())
    texts = Counter(b for t in set(pos) for b in toxicity._buckets(t).tolist())
    want = set()
    for b in of_pos | of_unl:
        p, u = (of_pos[b] + 0.5) / (len(pos) + 1), (of_unl[b] + 0.5) / (len(unl) + 1)
        z = abs(p - u) / (p * (1 - p) / len(pos) + u * (1 - u) / len(unl)) ** 0.5
        if z > 2.5 and (texts[b] if p > u else of_unl[b]) >= 5:
            want.add(b)
    got = set(toxicity._choose(made, 10_000).tolist())
    assert not got & {b for b in toxicity._buckets(copied).tolist()}
    assert len(got ^ want) <= 0.1 * len(want)  # texts that share half their words may count as copies
    assert len(toxicity._choose(made, 3)) == 3


def test_toxicity_weights_against_plain_code():
    """The risk's descent in loops over texts gives the same weights, through steps with a negative corrected risk."""
    rng = random.Random(2)
    rows = [np.array(sorted(rng.sample(range(6), 3) if i < 12 else rng.sample(range(3, 10), 3)), np.int32) for i in range(40)]
    positive = np.arange(40) < 12
    prior, steps, rate = 0.4, 60, 0.2
    words = sorted({int(b) for r in rows for b in r})
    w = {**dict.fromkeys(words, 0.0), "one": math.log(prior / (1 - prior))}
    m, v, signs = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), set()
    sig = lambda t: 1 / (1 + math.exp(-t))
    for step in range(1, steps + 1):
        f = [w["one"] + sum(w[int(b)] for b in r) for r in rows]
        corrected = sum(math.log1p(math.exp(t)) for t in f[12:]) / 28 - prior * sum(math.log1p(math.exp(t)) for t in f[:12]) / 12
        signs.add(corrected >= 0)
        for k in w:
            has = [k == "one" or k in r.tolist() for r in rows]
            sure = -prior * sum(sig(-f[i]) for i in range(12) if has[i]) / 12
            rest = sum(sig(f[i]) for i in range(12, 40) if has[i]) / 28 - prior * sum(sig(f[i]) for i in range(12) if has[i]) / 12
            g = (sure + rest if corrected >= 0 else -rest) + (0 if k == "one" else 0.03 / 12**0.5 * w[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        for k in w:
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / ((v[k] / (1 - 0.999**step)) ** 0.5 + 1e-5)
    model = toxicity.fit(rows, positive, prior, steps=steps, rate=rate)
    assert signs == {True, False}
    assert model.words.tolist() == words
    assert np.allclose(model.weights, [w[b] for b in words], atol=2e-3) and abs(model.intercept - w["one"]) < 2e-3


def test_long_texts_are_hashed_in_pieces():
    """The words of a text that is longer than a block are those of the whole, and the power tables stay small."""
    rng = random.Random(4)
    text = "".join(rng.choice(["word", "Other,", " ", "\n", "  ", "x-y", "été "]) for _ in range(40_000))
    for signs in (True, False):
        small, whole = WordArrays(signs, block=1000), WordArrays(signs, block=1 << 30)
        small._grow(2000)
        for a, b in zip(small.of(["a b", text, None, text]), whole.of(["a b", text, None, text])):
            assert a.tolist() == b.tolist()
        assert len(small.powers) < 10_000


def test_training_reads_each_id_once(spark, monkeypatch):
    """Half the rows have one id: the samples stay as small as said."""
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, positive, prior: sizes.append((len(rows), int(positive.sum()))))
    docs = spark.createDataFrame([(1 if i % 2 else i, f"word{i % 7} text") for i in range(4000)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(2, 180, 2)] * 3, "doc_id long, toxic int"), most_positive=20, most_unlabelled=50)
    assert sizes == [(70, 20)]
    monkeypatch.setattr(licences, "fit", lambda lines: sizes.append(len(lines)))
    licences.train(docs, most_background=30)
    assert sizes[1] == 7


def test_scores_against_plain_code(spark):
    """The query's scores are the model's, word by word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, SF).collect()}
    for r in docs.collect():
        parts = {toxicity._bucket(p) for c in (r["text"] or "").lower().split() for p in toxicity._parts(c)}
        score = 1 / (1 + np.exp(-(model.intercept + sum(weight.get(b, 0.0) for b in parts))))
        mine = got.pop(r["doc_id"])
        assert abs(mine["score"] - score) < 1e-5 and mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert mine["predicted"] == int(mine["score"] >= 0.5)
    assert not got


def test_nonnegative_risk_without_positives():
    m = toxicity.fit([np.array([1, 2], np.int32)], np.array([False]), 0.2)
    assert abs(1 / (1 + np.exp(-m.intercept)) - 0.2) < 1e-9


def test_shards_are_balanced_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["size"], r["shard"], r["slot"], r["text_crc32"], r["text"]) for r in sharding.shard_by_bytes(docs, 7).join(docs.select("doc_id", "text"), "doc_id").collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    total, at, seen = sum(r[1] for r in rows), 0, Counter()
    for _, size, shard, slot, crc, text in rows:
        assert shard == min((at + size - (size + 1) // 2) * 7 // total, 6)
        assert slot == seen[shard]
        assert crc == zlib.crc32(text.encode()) and size == len(text.encode()) + 16
        seen[shard] += 1
        at += size
    sums = Counter()
    for r in rows:
        sums[r[2]] += r[1]
    assert max(abs(s - total / 7) for s in sums.values()) <= max(r[1] for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("\\#</turn>: A01\n"), max_size=40))
def test_escape_round_trip(text):
    t = chat.Template()
    out = t.escape(text)
    assert t.unescape(out) == text
    assert all(c not in out for c in t.controls())


def test_chat_read_back(spark):
    hostile = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hostile), (1, 2, "assistant", None), (1, 3, "user", "q"), (1, 4, "assistant", hostile), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (3, 0, None, "r"), (3, 0, "tool: x\n", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, state int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    said = lambda c: sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
    for c, r in got.items():
        turns = said(c)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, None: False, 3: False}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(chat.format_turns(df).coalesce(1).orderBy(F.desc("segment"))).count()


def _brute_lines(docs, min_docs, keep):
    keyed = [[(x, x.strip(lines.SPACE).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) for x in (t or "").split("\n")] for _, t in docs]
    count = Counter(k for ks in {(d, tuple(k)) for (d, _), k in zip(docs, keyed)} for k in {k for _, k in ks[1] if k})
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    kept = {}
    for i in order:
        mine = []
        for x, k in keyed[i]:
            lose = bool(k) and (count[k] >= min_docs if keep == "none" else k in seen)
            seen.add(k)
            if not lose:
                mine.append(x)
        kept[i] = "\n".join(mine)
    for i in range(len(docs)):
        out.append(kept[i])
    return out


@pytest.mark.parametrize("held", [100_000, 2])
@pytest.mark.parametrize("keep", ["first", "none"])
def test_line_dedup_against_brute_force(spark, monkeypatch, keep, held):
    """Also where a task holds hardly any rows of a key."""
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["Hot", "hot ", "cold", "warm", "\u00c9t\u00c9", "", " ", "x" + str(rng.randrange(40))]) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lines, "HELD", held)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, 3, 1, keep).collect()}
    assert [got[i] for i, _ in docs] == _brute_lines(docs, 3, keep)


def _rows_of_lines(rows, size):
    """Sorted rows as a task gets them, in batches."""
    table = pa.table(dict(zip(["hash1", "hash2", "doc_id", "text_hash", "pos", "n_lines"], zip(*rows))))
    table = table.cast(pa.schema([(n, pa.int32() if n in ("pos", "n_lines") else pa.int64()) for n in table.column_names]))
    return table.to_batches(max_chunksize=size)


@pytest.mark.parametrize("held", [3, 1000])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_open_and_lost_rows_of_a_task(monkeypatch, held, size):
    """All rows of keys in three documents or more are lost, or open with the right count."""
    monkeypatch.setattr(lines, "HELD", held)
    monkeypatch.setattr(lines.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    rng = random.Random(size)
    rows = sorted((rng.randrange(6), 0, rng.randrange(5), 0, p, 300) for p in range(300))
    rows += [(9, 9, 1, 0, p, 300) for p in range(50)] + [(10, 0, 1, 0, 0, 1)]
    docs = {}
    for r in rows:
        docs.setdefault(r[:2], set()).add(r[2:4])
    lost, left, counts = Counter(), Counter(), {}
    for batch in lines._in_many(iter(_rows_of_lines(rows, size)), 3):
        for r in batch.to_pylist():
            if r["kind"] == "lost":
                lost[r["doc_id"], r["pos"]] += 1
            elif r["kind"] == "open":
                left[r["hash1"], r["hash2"]] += 1
            else:
                assert (r["hash1"], r["hash2"]) not in counts
                counts[r["hash1"], r["hash2"]] = r["docs"]
    assert {(0, 0), (10, 0)} <= set(counts) and set(counts) == set(left)
    assert counts == {k: len(docs[k]) for k in counts}
    assert left == {k: sum(r[:2] == k for r in rows) for k in counts}
    assert lost == Counter((r[2], r[4]) for r in rows if r[:2] not in counts and len(docs[r[:2]]) >= 3)


def test_a_line_five_million_times_in_few_documents_is_not_held(monkeypatch):
    """What a task holds stays small, however often a line repeats."""
    monkeypatch.setattr(lines.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    held = []

    def batches():
        for at in range(0, 5_000_000, 50_000):
            pos = pa.array(np.arange(at, at + 50_000, dtype=np.int32))
            one = lambda x: pa.array(np.full(50_000, x))
            yield pa.RecordBatch.from_arrays([one(1), one(1), one(at // 2_500_000), one(0), pos, pa.array(np.full(50_000, 5_000_000, np.int32))], names=["hash1", "hash2", "doc_id", "text_hash", "pos", "n_lines"])

    rows = 0
    for out in lines._in_many(batches(), 10):
        held.append(out.num_rows)
        rows += out.num_rows - (out.column(0)[0].as_py() == "count" if out.num_rows else 0)
    assert rows == 5_000_000 and max(held) <= lines.HELD + 50_000


def test_line_key_over_many_partitions(spark):
    """One line in all documents: its run spans every partition."""
    df = spark.createDataFrame([(i, f"same\nown {i}\nsame") for i in range(200)], "doc_id long, text string").repartition(3)
    out = lines.dedup_lines(df, 150, 1, "none").collect()
    assert all(r["text"] == f"own {r['doc_id']}" and r["n_dropped"] == 2 for r in out)
    first = lines.dedup_lines(df, keep="first").filter("text like 'same%'").collect()
    assert [r["doc_id"] for r in first] == [0]
    maps = lines.keep_bitmaps(df, 150, 1, "none").collect()
    assert {tuple(np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=3)) for r in maps} == {(0, 1, 0)}


def test_media_round_trip():
    for text in (b"", b"a", b"x" * 576, b"y" * 1000):
        p = audio.payload_of(text)
        assert len(p) % 576 == 0 and p and p.startswith(text) and set(p[len(text) :]) <= {255}
        assert audio.decode(audio.encode(p)) == p


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 6000
    peak = np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax() * 6000 / len(y)
    assert abs(peak - 440) < 2
    assert 0.8 < np.abs(y[500:-500]).max() < 1.2


def test_hysteresis():
    e = np.array([0, 5, 1, 1, -2, 1, 5, 5, -1, 0], dtype=float)
    assert audio.segments(e, high=3.0, low=-0.5).tolist() == [[1, 4], [6, 8]]


def test_resampling_against_a_plain_filter():
    """Zeros put in, one long low pass, samples left out; whole and in parts."""
    x = np.random.default_rng(1).normal(size=700).astype(np.float32)
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    t = np.arange(up * taps) - (up * taps - 1) / 2
    low_pass = np.sinc(t / max(up, down)) * np.hanning(up * taps + 2)[1:-1] / max(up, down) * up
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, low_pass)
    lead = up * (taps - 1 - taps // 2)
    want = [full[i * down + lead] for i in range(audio.resampled_length(len(x)))]
    assert np.allclose(audio.resample(x), want, atol=1e-5)
    for a, b in ((0, 1), (5, 9), (100, 400), (517, 525)):
        assert np.allclose(audio.resample(x, a, b), want[a:b], atol=1e-5)


def _plain_log_mel(y, rate):
    """Frame by frame, with a transform and triangles written out."""
    n, hop, bands = audio.FRAME, audio.HOP, audio.MELS
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(40.0), mel(rate / 2), bands + 2)]
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    out = []
    for at in range(0, max(1, len(y) - n + hop), hop):
        frame = np.zeros(n)
        frame[: len(y[at : at + n])] = y[at : at + n]
        power = np.abs(turn @ (frame * window)) ** 2
        row = []
        for low, middle, high in zip(edges, edges[1:], edges[2:]):
            weight = [max(0.0, min((k * rate / n - low) / (middle - low), (high - k * rate / n) / (high - middle))) for k in range(n // 2 + 1)]
            row.append(np.log10(power @ weight + 1e-3))
        out.append([*row, 10 * np.log10(power.sum() + 1e-3)])
    return np.array(out)


@pytest.mark.parametrize("size", [576, 40_000, 200_000])
def test_analysis_against_plain_code(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    y = audio.resample(np.frombuffer(payload, np.uint8).astype(np.float32) / 128 - 1)
    want = _plain_log_mel(y, audio.RATE * audio.UP / audio.DOWN)
    bands, spans = audio.analyze(payload)
    assert np.allclose(bands, want[:, :-1], atol=1e-3)
    assert spans.tolist() == audio.segments(want[:, -1].astype(np.float32)).tolist() or np.allclose(audio.log_mel(y)[:, -1], want[:, -1], atol=1e-2)


def test_query_media_against_plain_code(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_audio_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        payload = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        media = audio.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        bands, spans = audio.analyze(payload)
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert (int(said["frames"]), int(said["spans"])) == (len(bands), len(spans))
        assert abs(int(said["voiced_ms"]) - (spans[:, 1] - spans[:, 0]).sum() * audio.STEP_MS) <= 1
        assert np.abs(np.array(said["mel"].split(","), float) - bands.mean(axis=0) * 10).max() <= 0.53


def test_stored_tensors_and_spans(spark, awkward):
    folder = f"{checkpoint_root(spark)}/tensors-test"
    files = audio.store_features(audio.store_media(awkward.coalesce(2)), folder, group=7).collect()
    assert sum(r["documents"] for r in files) == len(AWKWARD)
    seen = Counter()
    for r in files:
        with open(r["path"], "rb") as file:
            for batch in audio.read_windows(file):
                assert tuple(batch.schema.field("logmel").type.shape) == (audio.WINDOW, audio.MELS)
                for row in batch.drop_columns(["logmel"]).to_pylist():
                    assert row["end_ms"] - row["start_ms"] == pytest.approx(row["frames"] * audio.STEP_MS)
                    assert all(row["start_ms"] <= a < row["end_ms"] and a < b for a, b in row["spans_ms"])
                    seen[row["window"]] += 1
    assert seen[0] == len(AWKWARD) and max(seen) > 10


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(3000)]
    items = [rng.choices(words, k=40) for _ in range(20)]
    docs, want = [], set()
    for i in range(200):
        text = rng.choices(words, k=200)
        if i % 5 == 0:
            j = i // 5 % 20
            copy = [w.upper() + "," if rng.random() < 0.3 else w for w in items[j]]
            for _ in range(i % 3 * 2):
                copy[rng.randrange(40)] = rng.choice(words)
            if i % 2:
                del copy[10]
                copy.insert(30, "extra")
            at = rng.randrange(200)
            text[at:at] = copy
            want.add((i, j))
        docs.append((i, " ".join(text)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    for block in (500_000, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, block_words=block).collect()}
        assert got == want


def test_query_leaks_against_brute_force(spark):
    """Every item aligned with every whole document, without seeds or windows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = WordArrays(signs=False)
    asked = words.of([r["text"] for r in items])
    want = {}
    for r, text in zip(docs, words.of([r["text"] for r in docs])):
        for at in range(0, len(asked), 50):
            some = asked[at : at + 50]
            score, _ = decontaminate.align(some, [text if len(text) else np.zeros(1, np.uint64)] * len(some))
            want |= {(r["doc_id"], items[at + k]["item_id"]): score[k] / (2 * len(some[k])) for k in np.flatnonzero(score >= [len(x) for x in some])}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op6_decontaminate(spark, SF).collect()}
    assert want and got == pytest.approx(want)


@pytest.mark.parametrize("common", [0.001, 1.0])
def test_decontamination_finds_copies_without_a_run_left(spark, common):
    """A word added or changed so often that no four words of the item stay together."""
    rng = random.Random(15)
    words = [f"t{i}" for i in range(3000)]
    item = rng.sample(words, 40)
    added = [x for k, w in enumerate(item) for x in ([w, "new"] if k % 3 == 2 else [w])]
    fourth, third = ["new" if k % 4 == 3 else w for k, w in enumerate(item)], ["new" if k % 3 == 2 else w for k, w in enumerate(item)]
    left_out = [w for k, w in enumerate(item) if k % 3 != 2]
    every = [x for w in item for x in (w, "new")]
    chance = rng.choices(words, k=40)
    docs = [(i, " ".join(rng.choices(words, k=60) + c + rng.choices(words, k=60))) for i, c in enumerate([added, fourth, third, left_out, every, chance])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_leaks(d, b, common=common).collect()} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_windows_hold_all_alignments(threshold, monkeypatch):
    """Few different words, common seeds and short stretches; every item against every whole text."""
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    rng, found = np.random.default_rng(4), 0
    for _ in range(60):
        items = [rng.integers(1, 12, rng.integers(4, 14)).astype(np.uint64) for _ in range(6)]
        text = np.concatenate([rng.integers(1, 30, 40), *[np.concatenate([x[: rng.integers(2, 14)], rng.integers(1, 30, 4)]) for x in items]]).astype(np.uint64)
        seeds = decontaminate.Seeds(items, threshold)
        seeds.use(rng.random(len(seeds.hashes)) < rng.choice([0.2, 0.8, 1.0]))
        got: dict = {}
        todo = [(("d", 0), 0, i, a, text[a:b]) for i, a, b in seeds.windows(text)]
        decontaminate._aligned(got, todo, items, threshold)
        score, _ = decontaminate.align(items, [text] * len(items))
        want = {(0, i): s / (2 * len(items[i])) for i, s in enumerate(score.tolist()) if s >= threshold * 2 * len(items[i])}
        assert {k: v[0][0] for k, v in got.items()} == pytest.approx(want)
        found += len(want)
    assert found > 50


def test_alignment_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 1000)
    todo = [(("d", 0), 0, 0, 0, np.zeros(n, np.uint64)) for n in (5, 900, 3, 5000, 400, 400, 90)]
    parts = decontaminate._parts(todo)
    assert sorted(len(x[4]) for p in parts for x in p) == [3, 5, 90, 400, 400, 900, 5000]
    assert all(len(p) == 1 or len(p) * max(len(x[4]) for x in p) <= 1000 for p in parts)


def test_decontamination_finds_passages_that_many_documents_repeat(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(3000)]
    items = [rng.choices(words, k=40) for _ in range(4)]
    every_seventh = [w if k % 7 else "edited" for k, w in enumerate(items[0])]
    every_sixth = [w if k % 6 else "edited" for k, w in enumerate(items[3])]
    # Item 0 edited only, item 1 in part only, item 2 whole and in part, item 3 whole and edited: each in far more documents than a rare seed.
    kinds = [(0, every_seventh), (1, items[1][:21]), (2, items[2]), (2, items[2][:24]), (3, items[3]), (3, every_sixth), (None, [])]
    docs, want = [], set()
    for i in range(210):
        j, passage = kinds[i % 7]
        text = rng.choices(words, k=100)
        text[50:50] = passage
        want |= {(i, j)} if passage else set()
        docs.append((i, " ".join(text)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b).collect()} == want


def test_decontamination_finds_short_items_inside_longer_texts(spark):
    d = spark.createDataFrame([(1, "one two three four five six"), (2, "Two, three!"), (3, "three two one"), (4, "six"), (5, "seven eight nine ten"), (6, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "two three"), (2, "six"), (3, "four five six"), (4, "seven eight nine ten")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in decontaminate.find_leaks(d, b).collect() if r["score"] == 1)
    assert got == [(1, 1, 1, 3), (1, 2, 5, 6), (1, 3, 3, 6), (2, 1, 0, 2), (4, 2, 0, 1), (5, 4, 0, 4)]


def test_alignment_against_plain_dynamic_program():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(2, 7, rng.integers(1, 12)).astype(np.uint64), rng.integers(2, 7, rng.integers(1, 15)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align([a], [b])[0][0] == h.max()


def _brute_classes(docs):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    texts = sorted({t or "" for _, t in docs})
    s = {t: sets(t) for t in texts}
    links, root = Counter(), {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        both = len(s[a] & s[b])
        if both >= 0.8 * (len(s[a]) + len(s[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    return {i: (find(t or ""), links[t or ""]) for i, t in docs}


@pytest.mark.parametrize("block", [512, 5])
def test_classes_against_brute_force(spark, monkeypatch, block):
    """Also with blocks and groups so small that all are cut."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    monkeypatch.setattr(jaccard, "GROUP", min(block, jaccard.GROUP))
    rng = random.Random(6)
    docs = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(50)}" for _ in range(60)]
        for _ in range(rng.randrange(1, 25)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(60)] = f"e{rng.randrange(9)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), ""), (len(docs) + 1, " "), (len(docs) + 2, "a b"), (len(docs) + 3, "A B")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(df).collect()}
    want = _brute_classes(docs)
    assert {i: r["n_links"] for i, r in got.items()} == {i: w[1] for i, w in want.items()}
    least = {}
    for i, (c, _) in want.items():
        least[c] = min(least.get(c, i), i)
    assert {i: r["class_id"] for i, r in got.items()} == {i: least[w[0]] for i, w in want.items()}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == sorted(set(least.values()))


def test_query_classes_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = _brute_classes(docs)
    got = {r["doc_id"]: r for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: w[1] for i, w in want.items()}
    assert len({r["class_id"] for r in got.values()}) == len({w[0] for w in want.values()})


def test_prefixes_are_shortened_by_what_the_probes_say():
    """The full label is tried first; links that only shorter prefixes find shorten it; without links the formula decides."""
    by_formula = next(d for d in range(jaccard.DEPTH, 0, -1) if jaccard.found_at(0.8, d) >= 0.9995)
    assert jaccard.shortened({}, 0.8, 0.9995) == by_formula < jaccard.DEPTH
    full = {i: {jaccard.DEPTH: 3} for i in range(100_000)}
    assert jaccard.shortened(full, 0.8, 0.9995) == jaccard.DEPTH
    for depth in (7, 5, 2):
        short = {i: {8: 1, depth: 1} if i % 10 == 0 else {8: 2} for i in range(100_000)}
        assert jaccard.shortened(short, 0.8, 0.9995) == depth
    assert jaccard.shortened({i: {0: 1} for i in range(1000)}, 0.8, 0.9995) == 1


def test_measured_depths_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PROBES", 20)
    rng = random.Random(2)
    docs = []
    for g in range(15):
        base = [f"g{g}w{i}" for i in range(80)]
        docs += [" ".join("edit" if rng.random() < 0.01 * k else w for w in base) for k in range(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    nodes = spark.createDataFrame(jaccard.signatures(df, 5).toArrow()).withColumnRenamed("doc_id", "node")
    rows = {r["node"]: (np.frombuffer(r["labels"], ">u2").reshape(16, 8), np.frombuffer(r["sketch"], np.uint8)) for r in nodes.collect()}
    probes = [r["node"] for r in nodes.selectExpr("node", "xxhash64(node) AS h").orderBy("h", "node").limit(20).collect()]
    want = {}
    for i, p in enumerate(probes):
        for q, (label, sk) in rows.items():
            if q != p and jaccard.shared(sk, rows[p][1]) >= jaccard.values_for(0.8):
                same = max(next((d for d in range(8) if a[d] != b[d]), 8) for a, b in zip(label, rows[p][0]))
                want.setdefault(i, Counter())[same] += 1
    assert jaccard.measured(nodes, 0.8) == {i: dict(c) for i, c in want.items()}


def test_dense_group_over_many_partitions(spark, monkeypatch):
    """A group of near copies that no task compares whole, beside texts that share its beginning alone."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(150)] = f"e{i}"
        docs.append((i, " ".join(copy)))
    docs += [(200 + i, " ".join([*base[:60], *(f"x{i}y{k}" for k in range(60))])) for i in range(30)]
    df = spark.createDataFrame(docs * 2, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["class_id"], r["n_copies"]) for r in jaccard.jaccard_classes(df).collect()}
    want = _brute_classes(docs)
    assert {i: g[0] for i, g in got.items()} == {i: w[1] for i, w in want.items()}
    assert {g[1] for i, g in got.items() if i < 200} == {0} and all(g[1] == i for i, g in got.items() if i >= 200)
    assert all(g[2] == 1 for g in got.values())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == 100


def test_licences_by_family(spark):
    model = licences.fit(["the house is green and old", "a story of two rivers"] * 40, each=40, steps=200)
    for family, texts in licences.TEMPLATES.items():
        for t in texts[:1]:
            assert model.classify(t)[0] == family, t
    assert model.classify("Licensed under the Zorquen License, version 7.1.")[0] == licences.UNKNOWN
    assert model.classify("He renewed his driving license last week.")[0] in (licences.BACKGROUND, licences.UNKNOWN)
    assert model.classify("plain words")[0] == licences.BACKGROUND


def test_licence_lines_that_a_third_of_the_documents_carry(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    prose = lambda: " ".join(rng.choices(words, k=12))
    frequent, seldom = "Licensed under the Apache License, Version 2.0.", "Licensed under the MIT license."
    docs = [(i, "\n".join([*([frequent] if i % 3 == 0 else [seldom] if i == 100 else []), prose(), prose()])) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["found"]] for r in licences.scan(d, licences.train(d)).collect()}
    assert got == {i: [(0, "apache-2.0")] if i % 3 == 0 else [(0, "mit")] if i == 100 else [] for i in range(300)}


GPL_3 = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
WRAPPED = {
    "gpl-3.0": GPL_3,
    "gpl-2.0": [x.replace("software:", "software;").replace("version 3", "version 2") for x in GPL_3],
    "bsd": ["Redistribution and use in source and binary", "forms, with or without modification, are", "permitted provided that the following", "conditions are met:"],
    "mit": ["Permission is hereby granted, free of charge, to any", "person obtaining a copy of this software and", "associated documentation files (the Software), to deal"],
    "apache-2.0": ["Licensed under the", "Apache License,", "Version 2.0."],
}
#: Notices in words that no template has.
HELD_OUT = {
    "agpl-3.0": ["You can redistribute it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."],
    "apache-2.0": ["You may obtain this software under the Apache License, Version 2.0", "Distributed under the Apache License 2.0"],
    "artistic-2.0": ["This library is distributed under the Artistic License 2.0"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
    "cc-by-nc-nd-4.0": ["This is an open access article under the CC BY-NC-ND 4.0 license", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"],
    "cc-by-nc-sa-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "Except where noted, content is under CC BY-NC-SA 4.0"],
    "cc-by-nd-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International", "The text of this report is licensed CC BY-ND 4.0"],
    "epl-2.0": ["All rights to this code are granted under the Eclipse Public License 2.0"],
    "zlib": ["This source is provided 'as-is', without any express or implied warranty.  In no event will the author be held liable for any damages arising from its use.", "Released under zlib license"],
    "bsd-3-clause": ["Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by-4.0": ["This is an open access article distributed under the Creative Commons Attribution License 4.0"],
    "cc-by-sa-4.0": ["This content is available under CC BY-SA 4.0 unless otherwise noted.", "Content is available under Creative Commons Attribution-ShareAlike"],
    "cc0-1.0": ["CC0 1.0 Universal: the author has waived all copyright and related rights"],
    "gpl-2.0": ["Foo is free software; you may redistribute it under the terms of version 2 of the GNU General Public License as published by the FSF.", "This file is licensed under GPL version 2.", "Foo is released under GPLv2"],
    "gpl-3.0": ["This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Code is available under the GNU GPL v3 license."],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies."],
    "lgpl-2.1": ["It may be redistributed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."],
    "mit": ["The MIT License (MIT)", "This software is released under the MIT license, see LICENSE.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "reserved": ["Copyright (c) 2024 Jane Doe. All rights reserved."],
    "unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
NO_LICENCE = [
    "The general public was free to modify the terms of the contest.", "A copy of the work was published by the foundation in version two.", "He holds a license to fish in the lake.", "The library lends books under simple conditions.",
    "Permission to park here is granted to residents.", "The source of the river is in the northern hills.", "All people have the same rights.", "The apache helicopter flew over the desert.", "She reserved a table at the restaurant.",
]


def test_held_out_notices_on_one_line_wrapped_and_commented():
    """Precision and recall of families on notices and plain sentences that training has not seen."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)] + "the use of a free copy public house work code".split()
    model = licences.fit([" ".join(rng.choices(words, k=12)) for _ in range(1500)])
    cases = [(f, x) for f, xs in HELD_OUT.items() for x in xs] + [(None, x) for x in NO_LICENCE]
    right = wrong = 0
    for family, text in cases:
        for form in ([text], textwrap.wrap(text, 60), ["# " + x for x in textwrap.wrap(text, 45)]):
            got = model.classify_lines(["a house is green", "", *form, "", "two rivers"])
            found = [x[1] for x in got if x[1] != licences.UNKNOWN]
            right += found == [family]
            wrong += len([f for f in found if f != family])
    assert wrong == 0 and right >= 0.95 * 3 * sum(map(len, HELD_OUT.values()))


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_hard_wrapped_licences(spark, mark):
    prose = ["the house is green and old", "a story of two rivers"]
    model = licences.fit(prose * 40)
    docs = [(i, "\n".join([prose[0], mark, *(mark + x for x in lines), mark, prose[1]])) for i, lines in enumerate(WRAPPED.values())]
    docs.append((9, "\n".join(["Licensed under the MIT license.", "Licensed under the Apache License, Version 2.0.", *prose])))
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["found"] if x["family"] != licences.UNKNOWN] for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got.pop(9) == [(0, "mit"), (1, "apache-2.0")]
    assert {k: [f for _, f in v] for k, v in got.items()} == {i: [family] for i, family in enumerate(WRAPPED)}


def test_query_licences_against_plain_code(spark):
    """Every line of every text, looked for by the sentences that the data plants."""
    planted = {"This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    got = {r["doc_id"]: r for r in queries.op8_licences(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in docs:
        lines = (r["text"] or "").split("\n")
        want = {planted[x] for x in lines if x in planted}
        assert set(filter(None, got[r["doc_id"]]["families"].split(","))) == want
        assert got[r["doc_id"]]["n_paragraphs"] == len(lines)
    assert len(got) == len(docs)


def test_wrapped_licence_that_a_third_of_the_documents_carry(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    prose = lambda: " ".join(rng.choices(words, k=12))
    docs = [(i, "\n".join([*(GPL_3 if i % 3 == 0 else []), prose(), prose()])) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["found"]] for r in licences.scan(d, licences.train(d)).collect()}
    assert got == {i: [(0, "gpl-3.0")] if i % 3 == 0 else [] for i in range(300)}


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "same " * 40
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (None, "http://n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "é", "\x1f\x8b\x08 " + "é" * 90), (1, "http://a", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"{checkpoint_root(spark)}/warc-test"
    archives = warc.write_archives(warc.mark_revisits(df), folder)
    for split in (37, 1 << 20):
        got = warc.read_archives(archives, folder, split_bytes=split).collect()
        assert len(got) == len(rows)
        by = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
        assert by[1, "response", None] == 2 and by[2, "revisit", 1] == by[3, "revisit", 1] == by[None, "revisit", 1] == 1
        assert by[4, "response", None] == by[5, "response", None] == by[6, "response", None] == 1
        for r in got:
            text = next(h for i, _, h in rows if i == r["page_id"]) or ""
            assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == text.encode()
    none = warc.write_archives(warc.mark_revisits(df.limit(0)), folder + "-none")
    assert none.count() == 0
    assert warc.read_archives(none, folder).count() == 0


class _Counted(io.BytesIO):
    """A file that counts the bytes read."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def _archive(n: int, seed: int = 3) -> tuple[bytes, list[int]]:
    rng, out, begins = random.Random(seed), b"", []
    for i in range(n):
        payload = rng.randbytes(rng.randrange(2000)).hex().encode()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        begins.append(len(out))
        out += z.compress(warc.record(i, f"http://{i}", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")) + z.flush()
    return out, begins


@pytest.mark.parametrize("split", [1, 1000, 100_000, 1 << 22])
def test_ranges_own_every_record_once_and_read_little(split):
    data, begins = _archive(60 if split == 1 else 1500)
    found, read = [], 0
    for start in range(0, len(data), split):
        with _Counted(data) as file:
            found += warc.members(file, start, min(start + split, len(data)), len(data))
            read += file.total
    assert [x[0] for x in found] == begins and all(x[2].startswith(b"WARC/") for x in found)
    assert sum(x[1] for x in found) == len(data)
    if split >= 100_000:
        assert read <= 1.2 * len(data)


@pytest.mark.parametrize("split", [500, 1 << 20])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "head"])
def test_damaged_archives_are_reported(split, harm):
    data, begins = _archive(50)
    ends = [*begins[1:], len(data)]
    lost = set()
    if harm == "flip":
        at = begins[20] + 40
        data, lost = data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :], {20}
    elif harm == "cut":
        data, lost = data[: begins[49] + 9], {49}
    elif harm == "junk":
        data = data[: begins[10]] + b"\x1f\x8b\x08junk" + data[begins[10] :]
    else:
        data, lost = b"x" * 30 + data[30:], {0}
    found = [x for start in range(0, len(data), split) for x in warc.members(io.BytesIO(data), start, min(start + split, len(data)), len(data))]
    gaps = [x[:2] for x in found if x[2] is None]
    want = {"flip": (begins[20], ends[20] - begins[20]), "cut": (begins[49], 9), "junk": (begins[10], 7), "head": (0, ends[0])}[harm]
    assert gaps == [want]
    assert sum(x[2] is not None for x in found) == 50 - len(lost)


def test_damaged_payloads_fail_or_give_rows(spark, tmp_path):
    data, begins = _archive(30)
    wrong = warc.record(7, None, b"changed", "0" * 64, None, "2024-01-01T00:00:00Z")
    data += zlib.compress(wrong, wbits=31) + b"tail"
    (tmp_path / "a.warc.gz").write_bytes(data)
    table = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, bytes long")
    rows = warc.read_archives(table, str(tmp_path), 4000, damage="report").collect()
    assert Counter(r["record_type"] for r in rows) == {"response": 30, "damaged": 2}
    assert sum(r["length"] for r in rows) == len(data)
    with pytest.raises(Exception, match="is damaged at byte"):
        warc.read_archives(table, str(tmp_path), 4000).count()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40_000), st.sampled_from([1, 64, 4096]))
def test_binary_lengths(n, limit):
    out = packing.binary_lengths(n, limit)
    assert sum(out) == n and all(x & (x - 1) == 0 and x <= limit for x in out)
    assert all(c == 1 for x, c in Counter(out).items() if x < limit)


ODD = ["", "  ", "Don't STOP'S <|endoftext|> x", "<|ENDOFTEXT|>", "İstanbul Ⅷ x² ½ éte \x1c\x1d a", "ΣΑΣ ΟΔΟΣ. 中文 日本 _a_b ...!?", "“hi”—there… ‘s’", "a b c d", "ß ẞ ÿ × ÷ ª º", "\u0301x ÿ", "a.b,c., d\x0b\x0ce\x85f", "x1y22 3.5,7"]


def test_tokens_equal_the_tokenizers(spark):
    tokens = packing.WordTokens(queries.tokenizer_path(), most=50)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    plain = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == [e.ids for e in plain]


def test_packing_is_whole(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, "word " * 9000)], "doc_id long, text string")
    rows = packing.pack(docs, queries.tokenizer_path(), limit=256).collect()
    tokenizer = packing.WordTokens(queries.tokenizer_path()).tokenizer
    for doc, text in [*enumerate(ODD), (99, "word " * 9000)]:
        mine = sorted((r["start"], r["length"], list(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert [x for m in mine for x in m[2]] == ids
        assert all(m[4] == len(ids) and m[3] == zlib.crc32(np.array(m[2], "<u4").tobytes()) for m in mine)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("signs", [True, False])
def test_word_arrays(spark, signs):
    """As many words as Python sees, equal hashes for equal words alone."""
    odd = ["", " ", "Hi, -- hi", "a\xa0b \u00abc\u00bb \u00bfqu\u00e9? \u0130 \u03a3\u0391\u03a3 x\u00b2", "a\x1cb\u2003c\u3000d", "\u201cq\u201d w\u2014v", None, "\u00e9 \u00c9 e-e _x_ 3.5", "x" * 100_000]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    hash_of, word_of = {}, {}
    for text, found in zip(texts, WordArrays(signs, block=5000).of(texts)):
        words = (text or "").lower().split()
        words = words if signs else [w for w in map(bare, words) if w]
        assert len(words) == len(found)
        for w, h in zip(words, found.tolist()):
            assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toArrow(), out.schema)
        assert 0 < kept.count() <= docs.count()
    want = {r["doc_id"] for r in kept.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    assert {r["doc_id"] for r in P.run(spark, SF).select("doc_id").distinct().collect()} == want
    leaks = decontaminate.find_leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert leaks.count() == 0


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    """Nulls, repeats, ties, a long text, and columns with the operators' own names."""
    import corpus_pipeline as P

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    hot = [(i, f"the very same line\nown words of {i}", "p", i, "s", "n", 1, 1) for i in range(20, 31)]
    leak = [(50, f"before it {item} and after", "q", 1, None, "n", 1, 1)] * 2
    docs = awkward.unionByName(spark.createDataFrame(hot + leak, DOCS))
    n = docs.count()
    kept = {name: stage(spark, docs, SF) for name, stage in P.STAGES[:-1]}
    assert all(out.columns == docs.columns for out in kept.values())
    assert kept["toxicity"].count() == n  # no toxic word among them
    lines_left = {(r["doc_id"], r["text"]) for r in kept["line_dedup"].collect()}
    assert {(i, f"own words of {i}") for i in range(20, 31)} <= lines_left and kept["line_dedup"].count() == n
    assert (2, None) in lines_left and (None, None) in lines_left
    assert kept["near_duplicates"].count() == 6 + 11 + 1
    assert kept["decontamination"].count() == n - 2 and kept["decontamination"].filter("doc_id = 50").count() == 0
    assert {r["n_lines"] for r in kept["line_dedup"].filter("doc_id = 20").collect()} == {20}  # a column of that name is left alone
    assert P.packing(spark, docs, SF).select("doc_id").distinct().count() == 6 + 11 + 1
    for name, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == empty.columns
