import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textgauge.llm import mixing
from textgauge.llm.sharding import shard_rows
from textgauge.llm.token_counts import LONG, SPACE, TrieCounter, load_pieces, token_counts


def plain_count(word, pieces, byte):
    """The same path without a trie: (score, -pieces) maximised left to right."""
    path, best = SPACE + word, [(0.0, 0)]
    for end in range(1, len(path) + 1):
        options = []
        c = path[end - 1]
        if c not in pieces:
            n = len(c.encode())
            options.append((best[end - 1][0] + n * byte, best[end - 1][1] - n))
        for start in range(end):
            if path[start:end] in pieces:
                options.append((best[start][0] + pieces[path[start:end]], best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_brute_force(spark):
    rng = random.Random(0)
    pieces = {SPACE: -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.0, "abc": -5.0, SPACE + "a": -3.5, "bca": -4.0, "é": -4.0, "éa": -4.2, "aaaa": -1.0}
    byte = TrieCounter(pieces).byte
    words = ["".join(rng.choice("aabbcéxß漢") for _ in range(rng.randint(1, 14))) for _ in range(600)]
    words += ["a" * (LONG + 50), "a" * 3, "ab" * 400]
    counter = TrieCounter(pieces)
    got = counter.count(words)
    assert got == {w: plain_count(w, pieces, byte) for w in set(words)}
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(rng.choices(words, k=rng.randint(0, 40))), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n ", "x"), (None, "ab c", "x"), (0, rows[0][1], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = Counter((r.doc_id, r.n_tokens, r.n_pretokens) for r in token_counts(d, pieces).collect())
    assert out == Counter((i, sum(got.get(w, 0) or plain_count(w, pieces, byte) for w in (t or "").split()), len((t or "").split())) for i, t, _ in rows)
    assert token_counts(d.limit(0), pieces).count() == 0


def test_public_pieces(spark):
    pieces = load_pieces()
    assert 30_000 < len(pieces) < 32_001 and abs(sum(np.exp(list(pieces.values()))) - 1) < 1e-6
    counter = TrieCounter(pieces)
    words = "the of unbelievable and Zusammenhang 漢字 x".split()
    assert counter.count(words) == {w: plain_count(w, pieces, counter.byte) for w in words}


@pytest.mark.parametrize("n,hot", [(0, 0), (3, 0), (500, 0), (500, 200), (203, 203)])
def test_sharding_laws(spark, n, hot):
    rng = random.Random(n)
    texts = ["hot"] * hot + [rng.choice(["é" * rng.randint(1, 9), None, "", f"text {rng.randint(0, 60)}", f"only {i}"]) for i in range(n - hot)]
    d = spark.createDataFrame([(i if i % 50 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, shard int, n int")
    got = shard_rows(d, 8).collect()
    assert len(got) == n
    sizes = Counter(r.shard for r in got)
    if n:
        assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(8)) <= 1 and set(sizes) <= set(range(8))
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    by_id = {i: t for i, t in enumerate(texts) if i % 50}
    for r in got:
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    # groups that fit stay together but for the rows that even out the shards
    if n == 500 and not hot:
        groups = Counter((t, r.shard) for r in got for t in [by_id.get(r.doc_id)] if t and t.startswith("text"))
        together = sum(max(v for (t, _), v in groups.items() if t == x) for x in {t for t, _ in groups})
        assert together >= 0.9 * sum(groups.values())


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


PARTS = {"aa": "the of and ing er on".split(), "bb": "el la de ción es".split(), "cc": "der und ung sch ein".split()}


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        g = rng.choices(list(PARTS), [6, 3, 1])[0]
        rows.append((i, prose(rng, PARTS[g], rng.randint(1, 80)), g if i % 3 else None, 0.5))
    rows += [(700, None, "aa", 0.1), (701, "", None, 0.1), (None, rows[0][1], None, 0.1), (0, rows[0][1], None, 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double")


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixing_meets_targets(spark, floor):
    d = corpus(spark)
    want = {"aa": 0.4, "bb": 0.3, "cc": 0.3}
    fitted = mixing.mixing_rates(d, d, want, floor=floor)
    rows, names = fitted.collect(), mixing.domains(fitted)
    assert len(rows) == 604 and all(r.reached and r.error <= mixing.WITHIN for r in rows)
    assert all(r.rate >= floor for r in rows)
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert np.allclose(p.sum(axis=1), 1)
    share = (t * r) @ p
    assert np.allclose(share / share.sum(), [want[k] for k in names], atol=0.01)
    if not floor:
        assert share.sum() == pytest.approx(t.sum(), rel=0.02)
    # the driver-side minimiser of the same problem
    lo, s = floor, t.sum()
    scale = s if not floor else max(s, max((t @ p) / np.array([want[k] for k in names])))
    x = np.ones(len(t))
    for _ in range(400):
        e = ((t * x) @ p - scale * np.array([want[k] for k in names])) / s
        x = np.maximum(lo, x - 1.5 * (p @ e + 3e-4 * (x - 1)))
    e = ((t * x) @ p - scale * np.array([want[k] for k in names])) / s
    mine = ((t * r) @ p - scale * np.array([want[k] for k in names])) / s
    assert np.abs(mine).max() <= np.abs(e).max() + 2e-3


def test_mixing_edges(spark):
    d = corpus(spark)
    assert mixing.mixing_rates(d.limit(0), d).count() == 0
    assert {r.rate for r in mixing.mixing_rates(d, d.where("false")).collect()} == {1.0}
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.rate for r in mixing.mixing_rates(blank, d).collect()] == [1.0, 1.0]
    members = mixing.membership(d.where("doc_id % 2 = 1 AND domain IS NOT NULL"), d.where("doc_id % 2 = 0"))
    held, names = members.join(d.drop("rate"), "doc_id").collect(), mixing.domains(members)
    right = [max(zip(r.posterior, names, strict=True))[1] == r.domain for r in held if r.n_tokens > 4]
    assert sum(right) >= 0.97 * len(right)


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixing_meets_rare_targets(spark, floor):
    rng = np.random.default_rng(4)
    share = np.array([0.8, 0.1475, 0.05, 0.002, 0.0005])
    domain = np.concatenate([np.arange(5), rng.choice(5, 40000, p=share)])
    post = np.full((len(domain), 5), 1e-6)
    post[np.arange(len(domain)), domain] = 1 - 4e-6
    names = [f"d{k}" for k in range(5)]
    d = mixing.named(spark.createDataFrame([(i, 100, p) for i, p in enumerate(post.tolist())], MEMBERS), names)
    rate = np.array([r.rate for r in mixing.fit_rates(d, None, floor, 0.7).select("doc_id", "rate").orderBy("doc_id").collect()])
    now = post.sum(axis=0)
    want = now**0.7 / (now**0.7).sum()
    got = rate @ post
    assert rate.min() >= floor
    assert np.abs(got / got.sum() / want - 1).max() < 0.01
    with pytest.raises(ValueError):
        mixing.fit_rates(d, {"d0": 0.5, "nowhere": 0.5}, floor, 0.7)


def test_sharding_goes_on_past_full_shards(spark):
    texts = ["hot"] * 3300 + [f"pair {k}" for k in range(660) for _ in range(5)] + [f"only {k}" for k in range(3400)]
    random.Random(1).shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shard_rows(d, 8).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 10000 and max(sizes.values()) - min(sizes.values()) <= 1
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(where["hot"]) <= 4
    assert sum(len(v) > 1 for k, v in where.items() if k.startswith("pair")) <= 6


def test_mixing_keeps_every_domain(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abcdefghij") for _ in range(12)) + f" q{k}", f"d{k % 70:02d}") for k in range(210)]
    rows += [(1000 + k, rows[0][1], "d00") for k in range(20000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.learn_domains(d)
    assert len(model.names) == 70
    assert all(np.ptp(model.table[:, k] - model.table[:, [j for j in range(70) if j != k]].mean(axis=1)) > 0.1 for k in range(70))


MEMBERS = "doc_id long, n_tokens long, posterior array<double>"


def test_mixing_is_nearest_to_one(spark):
    rng = np.random.default_rng(9)
    post = rng.dirichlet([0.4, 0.3, 0.2], 400)
    t = rng.integers(0, 90, 400)
    d = mixing.named(spark.createDataFrame([(i, int(n), p) for i, (n, p) in enumerate(zip(t, post.tolist(), strict=True))], MEMBERS).coalesce(1), list("abc"))
    want = np.array([0.1, 0.2, 0.7])
    fit = mixing.solve(d, dict(zip("abc", want.tolist(), strict=True)), 0.0, 0.7)
    rate = fit.rates(post)
    got = (t * rate) @ post / t.sum()
    assert rate.min() >= 0 and fit.error == pytest.approx(np.abs(got / want - 1).max(), abs=1e-9) and fit.error <= mixing.CLOSE
    # as near to one as any rates that meet the targets: a plain projected gradient with a small pull
    x, w = np.ones(400), t / t.sum()
    base = w @ post
    for _ in range(20000):
        x = np.maximum(0, x - post @ (((w * x) @ post - want) / base) - 1e-4 * (x - 1))
    assert np.abs(rate - x).max() < 0.05
    # targets out of reach end, and say how far they are missed: no row is all one domain
    far = mixing.solve(d.where("posterior[1] > 0.3"), {"a": 1.0}, 0.0, 0.7)
    assert 0.05 < far.error <= 1 and 0 <= far.gap <= mixing.GAP and not far.reached


def nonnegative_least_squares(a, b):
    """Active sets: add the column of steepest descent, drop those that turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(20 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if active.all() or slope.max() <= 1e-10:
            break
        active[slope.argmax()] = True
        while True:
            z = np.zeros(len(x))
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                break
            low = active & (z <= 0)
            part = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + part * (z - x)
            active &= x > 1e-14
        x = z
    return x


def test_mixing_reaches_what_can_be_reached(spark, monkeypatch):
    """Random soft memberships and targets: met within 0.5 % where nonnegative rates can,
    else as good as active sets find them, in a bounded number of passes."""
    rng = np.random.default_rng(12)
    reached = 0
    for trial in range(14):
        width, floor = int(rng.integers(2, 8)) if trial else 4, float(trial % 2)
        post = rng.dirichlet(rng.uniform(0.1, 3) * rng.uniform(0.2, 2, width), 300)
        t = rng.integers(1, 500, 300).astype(float)
        share = rng.dirichlet(np.ones(width) * rng.choice([0.3, 1, 3])) if trial else np.array([0.02, 0.03, 0.05, 0.9])
        names = [f"d{k}" for k in range(width)]
        monkeypatch.setattr(mixing._Passes, "__init__", numpy_passes(post, t))
        monkeypatch.setattr(mixing._Passes, "at", numpy_at)
        monkeypatch.setattr(mixing._Passes, "least", lambda self, y: self.passed() or float((self.p @ y).min()))
        d = Members(names)
        fit = mixing.solve(d, dict(zip(names, share.tolist(), strict=True)), floor, 0.7)
        w = t / t.sum()
        now = w @ post
        target = share * (max(1, (now / share).max()) if floor else 1)
        # rates are the floor and something nonnegative beside it
        a, b = (post * w[:, None]).T / target[:, None], 1 - floor * now / target
        best = np.linalg.norm(a @ nonnegative_least_squares(a, b) - b)
        rate = fit.rates(post)
        mine = np.linalg.norm((w * rate) @ post / target - 1)
        assert rate.min() >= floor and fit.passes < 120
        assert fit.reached and mine <= 0.005 * width if best < 1e-6 else mine <= best * (1 + 2e-3) + 1e-6
        assert fit.reached == (fit.error <= 0.005) and fit.gap <= mixing.GAP
        reached += fit.reached
    assert 3 <= reached < 14


class Members:
    """Names of domains without rows: the passes of the test above are plain arrays."""

    def __init__(self, names):
        self.schema = {"posterior": type("Field", (), {"metadata": {"domains": names}})}


def numpy_passes(post, t):
    def init(self, members, width, floor):
        self.p, self.t, self.width, self.floor, self.taken = post, t, width, floor, 0
        self.passed = lambda: setattr(self, "taken", self.taken + 1)

    return init


def numpy_at(self, moves):
    self.passed()
    out = []
    for m in moves:
        z = max(1.0, self.floor) - self.p @ m
        rate, free = np.maximum(z, self.floor), z > self.floor
        out.append(mixing._Sums((self.t * rate) @ self.p, (self.p * (self.t * free)[:, None]).T @ self.p, float(self.t @ np.where(free, z * z / 2, self.floor * z - self.floor**2 / 2))))
    return out


def test_mixing_passes_over_rows(spark):
    """A pass over a table gives the sums of the plain formula, for rows in many partitions."""
    rng = np.random.default_rng(2)
    post, t = rng.dirichlet([1, 1, 1], 500), rng.integers(0, 50, 500)
    d = spark.createDataFrame([(i, int(n), p) for i, (n, p) in enumerate(zip(t, post.tolist(), strict=True))], MEMBERS).repartition(5)
    moves = [np.zeros(3), np.array([0.5, -2.0, 3.0])]
    for floor in (0.0, 1.0):
        real, plain = mixing._Passes(d, 3, floor), mixing._Passes.__new__(mixing._Passes)
        numpy_passes(post, t.astype(float))(plain, None, 3, floor)
        for x, y in zip(real.at(moves), numpy_at(plain, moves), strict=True):
            assert np.allclose(x.totals, y.totals) and np.allclose(x.curvature, y.curvature) and x.potential == pytest.approx(y.potential)
        assert real.least(moves[1]) == pytest.approx((post[t > 0] @ moves[1]).min())
