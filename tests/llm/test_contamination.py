import hashlib
import random
import re

import numpy as np
import pytest

from textgauge.llm.contamination import FMIndex, contaminated_spans, digest, strip_spans, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha256_of(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("null" if name is None else str(name))
    sizes = {len(p) for p in wins}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (p := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    found |= wins[p]
        out.append((i, len(w), len(hit), len(found), sha256_of(list(found)), bool(hit)))
    return out


def data(seed):
    rng = random.Random(seed)
    vocab = ["the", "Of", "naïve", "été", "x1", "b", "c", "dd", "e-e", "ƒ", "ß"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([12, 15, 30, 30, 9, 10]))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, text(4)), (None, text(14))]
    items.append((99, items[0][1]))
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 10))
            t += " Zq " * rng.randint(0, 1) + " " + " ".join(w[a : a + rng.randint(5, 14)]).upper() + " "
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "the " * 3000), (103, items[1][1] * 40), (0, docs[0][1]), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination_brute_force(spark, seed):
    docs, items = data(seed)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute(docs, items), key=key)
    spans = contaminated_spans(d, b)
    assert sorted(map(tuple, digest(spans).collect()), key=key) == want
    blocks = digest(contaminated_spans(d, b, block_bytes=700))
    assert sorted(map(tuple, blocks.collect()), key=key) == want
    many = digest(contaminated_spans(d.repartition(5), b, block_bytes=120))
    assert sorted(map(tuple, many.collect()), key=key) == want
    cut = lambda size: sorted((tuple(r) for r in strip_spans(d, b, block_bytes=size).collect()), key=str)
    assert cut(1 << 24) == cut(300)
    # what is left of stripped texts holds every word that was not hit
    left = {r.doc_id: r.text for r in strip_spans(d, b).collect() if r.doc_id is not None}
    for (i, n, hit, *_), (_, text) in zip(brute(docs, items), docs, strict=True):
        if i is not None and i != 0:
            assert len(words(left[i])) == n - hit
            assert hit or left[i] == text


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contaminated_spans(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert digest(contaminated_spans(one, b)).collect()[0][1:4] == (3, 0, 0)


def test_fm_index():
    rng = np.random.default_rng(4)
    for _ in range(20):
        s = rng.integers(0, 4, rng.integers(1, 200)).astype(np.int32)
        s = np.concatenate([s, np.ones(40, np.int32), np.ones(40, np.int32), [0]]).astype(np.int32)
        zeros = np.flatnonzero(s == 0)
        code = s.astype(np.int64) + 1000
        code[zeros] = np.arange(len(zeros))
        want = sorted(range(len(s)), key=lambda i: code[i:].tolist())
        assert suffix_array(s).tolist() == want
        index = FMIndex(s)
        for k in (1, 2, 3, 5):
            p = rng.integers(1, 4, (30, k))
            low, high = index.search(p)
            for row, a, z in zip(p, low, high, strict=True):
                where = [i for i in range(len(s) - k + 1) if (s[i : i + k] == row).all()]
                assert sorted(index.locate(np.arange(a, z)).tolist()) == where


def test_phrases_beyond_a_shards_alphabet():
    index = FMIndex(np.array([1, 2, 1, 2, 0], np.int32))
    low, high = index.search(np.array([[1, 2], [900, 1], [1, 5000], [2, 3], [3, 1]]))
    assert (high - low).tolist() == [2, 0, 0, 0, 0]


@pytest.mark.parametrize("block_bytes", [1 << 24, 200, 20])
def test_repeated_benchmark_rows(spark, block_bytes):
    b = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta epsilon"), (2, "zeta eta")], "item_id long, text string")
    d = spark.createDataFrame([(5, "x alpha beta gamma delta epsilon y zeta eta")], "doc_id long, text string")
    assert [r["items"] for r in contaminated_spans(d, b, block_bytes=block_bytes).collect()] == [["1", "2"]]


@pytest.mark.parametrize("block_bytes", [1 << 24, 150])
def test_repeated_ids_and_rows(spark, block_bytes):
    """Rows that share an id, a text or both, in the benchmark and the documents."""
    items = [(1, "one two three four"), (1, "five six seven"), (1, "one two three four"), (2, "one two three four"), (None, "eight nine"), (3, None)]
    docs = [(7, "x one two three four y")] * 3 + [(7, "five six seven eight nine"), (8, "x one two three four y"), (None, "eight nine"), (9, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(map(tuple, digest(contaminated_spans(d, b, block_bytes=block_bytes)).collect()), key=key)
    assert got == sorted(brute(docs, items), key=key)


def test_long_shard(spark):
    """A document far beyond a shard, with occurrences at both ends."""
    phrase = "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1"
    text = f"{phrase} " + "filler words of no kind " * 200_000 + phrase
    d = spark.createDataFrame([(1, text), (2, "z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    assert [tuple(r)[1:4] for r in digest(contaminated_spans(d, b)).orderBy("doc_id").collect()] == [(1_000_020, 20, 1), (1, 0, 0)]
