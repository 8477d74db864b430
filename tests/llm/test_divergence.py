import random
import re
from collections import Counter

import pytest

from textgauge.llm import divergence as module
from textgauge.llm.divergence import divergence

KIND = "doc_id long, text string, lang string, source string, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows, least, top):
    """The contract read term by term, over all kept terms of each pair."""
    docs = [(lang or "", source or "", TERM.findall(fold(text))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        of = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        of[None] = Counter(t for d in mine for t in d[2])
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            if s is None:
                continue
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o not in (s, None)]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def table(rng, n, words, sources):
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}"
        text = " ".join(rng.choice(words).replace("e", rng.choice("eE")) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", "ß"]), source, "x"))
    return rows


@pytest.mark.parametrize("least,top,most", [(3, 200, 1 << 21), (2, 5, 50), (3, 3, 1), (10_000, 5, 1 << 21)])
def test_by_brute_force(spark, monkeypatch, least, top, most):
    rng = random.Random(top)
    words = ["".join(rng.choice("aeéßxyZ漢\U0001f600") for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["the"] * 80
    rows = table(rng, 160, words, 6)
    rows += [(900, None, "en", "s1", "x"), (901, "", None, None, "x"), (902, "the the 12", None, "", "x"), (None, "the-the'THE", "en", None, "x"), (1, *rows[1][1:]), (1, *rows[1][1:])]
    rows += [(903, "12 34", "zz", "a", "x"), (904, "12", "zz", "b", "x"), (905, "only", "one", "a", "x"), (906, "long " * 30_000 + "e" * 5000, "en", "s2", "x")]
    monkeypatch.setattr(module, "_ROWS", most)
    got = divergence(spark.createDataFrame(rows, KIND).repartition(5), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, least, top)


def test_empty_tables(spark):
    assert divergence(spark.createDataFrame([], KIND)).collect() == []
    alone = divergence(spark.createDataFrame([(1, "a a a", "en", "x", None)], KIND)).collect()
    assert alone == []
    no_terms = divergence(spark.createDataFrame([(1, "1", "en", "x", None), (2, None, "en", "y", None)], KIND)).collect()
    assert sorted(tuple(r) for r in no_terms) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_a_hot_source_and_large_counts(spark):
    rows = [(i, "the " * 2000 + "rare", "en", "hot", "x") for i in range(40)] + [(100 + i, f"the w{i % 3} cold", "en", f"s{i % 2}", "x") for i in range(12)]
    assert sorted(tuple(r) for r in divergence(spark.createDataFrame(rows, KIND)).collect()) == by_hand(rows, 3, 200)
