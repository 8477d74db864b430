import random
import re

import numpy as np
import pytest

from textgauge.llm.common import join_counted
from textgauge.llm.components import components
from textgauge.llm.ngram_join import apart, near_duplicates, near_pairs


def shingles(text, width):
    w = re.findall("[^ \t-\r]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    at = {i: i for i, _ in rows if i is not None}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is None or j is None or not sets[x] or not sets[y]:
                continue
            o = len(sets[x] & sets[y])
            if 100 * o >= percent * (len(sets[x]) + len(sets[y]) - o):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("seed,width,percent", [(0, 4, 85), (1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_brute_force(spark, seed, width, percent):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "γ", "d", "e-f", "été"]) + str(rng.randint(0, 60))
    text = lambda n: [word() for _ in range(n)]
    bases = [text(rng.randint(1, 80)) for _ in range(8)]
    rows = []
    for i in range(260):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(w) + 1)
            op = rng.randint(0, 3)
            if op == 0:
                w.insert(k, word())
            elif op == 1 and w:
                w.pop(k - 1)
            elif op == 2 and w:
                w[k - 1] = word()
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "ONE"), (405, "x " * 3000), (406, "x " * 2000), (None, rows[0][1]), (3, " ".join(bases[0])), (407, "a b c"), (408, "A b  c")]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, rep string")
    got = near_duplicates(d, width, percent).drop("n_same").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:2])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, width, percent), key=key)
    if seed == 0:
        # the counts by relays: 9 owners in 3 groups, 11 buckets in 4 slices
        again = near_duplicates(d, width, percent, 11, 7, most_blobs=1).drop("n_same").collect()
        assert sorted(map(tuple, again), key=key) == sorted(map(tuple, got), key=key)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        real = len(set(x.tolist()) ^ set(y.tolist()))
        for most in (2, 5, 10, 100):
            bound = apart(x, y, most, 3)
            assert bound <= real


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


def test_join_counted_broadcasts_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("lone", 3)], "k string, v long")
    right = spark.createDataFrame([("hot", 50, "H"), ("a", 1, "A"), ("b", 1, "B")], "k string, n long, w string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, join_counted(left, right, ["k"], "n", how, least=5).select("k", "v", "n", "w").collect()), key=str) == want
        assert sorted(map(tuple, join_counted(left, right, ["k"], "n", how).select("k", "v", "n", "w").collect()), key=str) == want


@pytest.mark.parametrize("seed,size", [(5, 30), (6, 700)])
def test_pairs_brute_force(spark, seed, size):
    """Every link between different sets; the larger size has over RECENT postings in a document."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(size // 2, size))] for _ in range(4)]
    rows = []
    for i in range(70):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(2, size // 30))):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 4000)}"
        rows.append((i, " ".join(w)))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (None, rows[4][1])]
    links, members = near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60)
    rep = {r.doc_id: r.rep for r in members.collect() if r.doc_id is not None}
    sets = {i: shingles(t, 3) for i, t in rows if i is not None}
    assert rep[200] == 3 and rep[201] is None and rep[202] is None
    want = set()
    for i in sets:
        for j in sets:
            if i < j and rep[i] == i and rep[j] == j and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]) > 0:
                want.add((i, j))
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 50


def test_frequent_words_and_lists(spark):
    """A template that a third of all rows share, in lists of documents of mixed lengths."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(120)]
    rows = [(i, " ".join(template + [f"x{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 40, 90]))])) for i in range(120)]
    rows += [(200 + i, " ".join(f"y{rng.randint(0, 300)}" for _ in range(60))) for i in range(120)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).drop("n_same").collect()
    key = lambda r: r[0]
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 4, 85), key=key)
