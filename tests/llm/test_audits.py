"""Source divergence, substring deduplication and spelling variants against plain definitions, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import divergence, spelling, substrings
from larder.llm.common import table
from larder.llm.wordhash import WordArrays
from tests.llm.test_llm import AWKWARD, DOCS


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- divergence ----------------------------------------------------------------------------------


def plain_divergence(rows, min_docs, top, smoothing=5):
    """rows: (text, lang, source)."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(low(t or ""), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t), s) for t, x, s in rows if x == lang]
        kept = {w for w, n in Counter(w for words, _ in mine for w in set(words)).items() if n >= min_docs}
        counts = defaultdict(Counter)
        for words, s in mine:
            counts[s].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + smoothing) // (sum(c.values()) + smoothing * len(kept))
        for s, c in counts.items():
            pairs = sorted(((-sum(abs(share(c, w) - share(d, w)) for w in kept), o.encode()) for o, d in counts.items() if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((share(whole, w) - share(c, w), w.encode()) for w in kept if c[w] and share(c, w) > share(whole, w))
            out |= {(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(terms[:top], 1)}
    return out


def test_divergence_in_many_tiles(spark):
    rng = random.Random(4)
    words = [f"w{c}{d}é" for c in "abcdefgh" for d in "klmnopq"] + ["ÀB", "日本"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["x", "y", None]), rng.choice([None, *"abcdefghijk"])) for _ in range(400)]
    rows += [(None, "z", "only"), ("", "z", "other"), ("a1b a", "lone", "s"), ("common " * 300, "x", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.divergence(docs, 3, 4).collect()
    want = plain_divergence(rows, 3, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    kept = table(divergence.kept_terms(docs, 3), "kept")
    groups = table(divergence.group_table(docs, kept), "groups")
    pairs = {(r["lang"], r["source"], r["item"], r["value"]) for r in divergence.pair_divergences(kept, groups, chunk=5, span=2, per_block=3).collect()}
    assert pairs == {(r[0], r[1], r[3], r[4]) for r in want if r[2] == "pair"}


def test_divergence_shares_do_not_overflow():
    for n, total, v in ((0, 0, 1), (10**15, 9 * 10**15, 10**6), (3, 7, 2), (123456789012345, 987654321098765, 4321)):
        exact = 1 + 10**9 * (n + 5) // (total + 5 * v)
        assert divergence.share(np.array([n]), np.array([total]), v, 5)[0] == exact


def test_divergence_on_awkward_rows(spark, empty):
    docs = spark.createDataFrame([(r[1], "en" if i % 2 else None, r[2], 1) for i, r in enumerate(AWKWARD)], "text string, lang string, source string, term int")
    want = plain_divergence([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 1, 50)
    assert {tuple(r) for r in divergence.divergence(docs, 1).collect()} == want
    assert divergence.divergence(empty.selectExpr("text", "score AS lang", "size AS source")).count() == 0


def test_pieces_keep_terms_whole():
    data = ("ab" * 40 + " " + "c " * 60).encode()
    assert [w for p in divergence.pieces(data, 16) for w in p.split()] == data.split()


# --- substrings ----------------------------------------------------------------------------------


def plain_repeats(rows, window):
    """(doc_id, text) -> (number of words, removed, kept) of each row."""
    words = [re.findall("[^ \t-\r]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts_with_repeats(rng, n, window):
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(window // 2, 4 * window))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [f"{rng.randrange(10**6)}" for _ in range(rng.randrange(window))] for _ in range(rng.randrange(5))]
        words = [w for p in parts for w in p]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,hot", [(6, 200), (7, 2), (50, 200), (1, 200)])
def test_repeats_against_all_windows(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARE", 1 << 30)
    rows = texts_with_repeats(random.Random(window), 250, window) + [(400, "same " * 300), (401, "same " * 280 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.drop_repeats(docs.repartition(3), window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], " ".join(r["text"].split()) if not r["n_removed"] else r["text"]) for r in out}
    assert len(out) == len(rows) and got == {d: (n, k, t) for d, n, k, t in plain_repeats(rows, window)}


def test_repeats_spans_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"x {shared} y z"), (3, " ".join(shared.split()[:49]))], "doc_id long, text string")
    (row,) = substrings.repeats(docs).collect()
    assert (row["doc_id"], row["n_removed"], row["kept"]) == (2, 80, "x y z") and [tuple(s) for s in row["spans"]] == [(1, 81)]


def test_repeats_on_awkward_rows(spark, empty):
    long = "".join(f"u{i} " for i in range(400_000))  # 2.9 MB in one text
    more = [(7, long, *[None] * 6), (9, "start " + long, *[None] * 6), (9, "x", *[None] * 6), (None, long[:5000], *[None] * 6), (4, "word " * 60, *[None] * 6), (11, "word " * 60, *[None] * 6), (11, "word " * 60, *[None] * 6)]
    rows = AWKWARD + more
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_lines", "n_words")
    out = substrings.drop_repeats(docs)
    assert set(out.columns) == {*docs.columns, "n_removed"}
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.md5(" ".join((r["text"] or "").split()).encode()).hexdigest()) for r in out.collect())
    assert got == Counter((d, n, k, hashlib.md5(t.encode()).hexdigest()) for d, n, k, t in plain_repeats([r[:2] for r in rows], 50))
    assert substrings.drop_repeats(empty).count() == 0 and substrings.repeats(empty).count() == 0


def test_hashes_of_long_texts_in_pieces():
    arrays, text = WordArrays(block=64), b" ".join(b"w%d" % i for i in range(300)) + b"\x0b" + b"q" * 500 + b"  "
    (got,) = arrays.raw([text])
    assert got.tolist() == WordArrays().raw([text])[0].tolist() and len(got) == 301
    assert [len(x) for x in arrays.raw([b"", b" ", text, b"a b"])] == [0, 0, 301, 2]


def test_wide_keys_that_share_their_first_half():
    index = substrings._Index()
    keys = np.zeros(3, substrings.WIDE)
    keys["a"], keys["b"] = [5, 5, 9], [1, 2, 3]
    index.add((keys, np.array([10, 20, 30]), np.zeros(3, np.int64), np.zeros(3, np.int64), np.ones(3, np.int64)))
    index.settle()
    found, at = index.find(keys[[1, 0, 2]])
    assert found.all() and index.least[1][index.first[at]].tolist() == [20, 10, 30]


# --- spelling ------------------------------------------------------------------------------------


def plain_variants(rows, min_chars=7, min_count=2, ratio=10, noise=31):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= min_count and len(w) >= min_chars}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: best for w, vs in close.items() if vs for best in [min(vs, key=lambda v: (-n[v], v))] if n[best] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(close[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def test_spelling_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choices("abÀé", k=rng.randrange(7, 11))) for _ in range(12)] + ["ab" * 33, "x" * 66, "ba" * 40]
    rows = []
    for i in range(300):
        words = []
        for _ in range(12):
            w = rng.choice(base[:3] if rng.random() < 0.6 else base)
            if rng.random() < 0.35:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÀéz") + w[at:], w[:at] + rng.choice("abÀéz") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((i if i % 50 else None, rng.choice([" ", "日", "1", "Ā"]).join(words)))
    rows += [(1, None), (2, ""), (3, "short words only"), (3, "repeated repeated repeated"), (3, "repeated repeated repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS id", "'k' AS key")
    got = spelling.spelling_variants(docs.repartition(3)).collect()
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got} == (want := plain_variants(rows)) and len(got) == len(want)
    assert any(len(w[0]) > 64 and w[3] for w in want) and any(w[5] != w[3] != None for w in want)  # noqa: E711


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_variants(empty).count() == 0


def test_spelling_of_a_very_long_run(spark):
    """100,000 letters cost their length, not its square."""
    run = "".join(random.Random(3).choices("abcdef", k=100_000))
    docs = spark.createDataFrame([(1, f"{run} {run}"), (2, f"{run} " * 30), (3, f"{run[:5000]}z{run[5000:]} " * 2)], "doc_id long, text string")
    got = {len(r["word"]): (r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs, noise=1 << 40).collect()}
    assert got == {100_000: (32, 1, None), 100_001: (2, 1, 32)}


def test_repeats_of_a_text_in_segments(spark):
    """Longer than a task gathers: hashed and asked for in segments."""
    long = " ".join(f"u{i}" for i in range(2 * substrings.GATHER + 70_000))
    docs = spark.createDataFrame([(1, long), (2, f"x y {long} z"), (3, "u" + long[-3000:])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.repeats(docs).collect()}
    assert set(got) == {2, 3} and got[2]["kept"] == "x y z" and got[2]["n_removed"] == 2 * substrings.GATHER + 70_000
    assert got[3]["kept"] == ("u" + long[-3000:]).split()[0] and [tuple(s) for s in got[2]["spans"]] == [(2, 2 * substrings.GATHER + 70_002)]
