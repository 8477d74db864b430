import math

import numpy as np
import pytest

from textgauge.llm.whitening import block_lanczos, by_component, orthogonal, whiten

INF, NAN = float("inf"), float("nan")


def by_hand(vectors, k):
    """Exact deviations, and the whitened rows by a dense eigen decomposition."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    c = np.array(y, float) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return [sum(v * v for v in r) for r in y], c @ turn / np.sqrt(values), values / np.trace(c.T @ c / n)


def same_up_to_sign(a, b):
    return all(np.allclose(a[:, k], b[:, k], atol=1e-9) or np.allclose(a[:, k], -b[:, k], atol=1e-9) for k in range(a.shape[1]))


@pytest.mark.parametrize("n,d,components", [(300, 20, 8), (40, 3, 8), (12, 30, 8)])
def test_against_dense(spark, n, d, components):
    rng = np.random.default_rng(n)
    v = (rng.standard_normal((n, d)) * 0.9 ** np.arange(d)).astype(np.float32).astype(float)
    rows = [(i, r.tolist(), "x") for i, r in enumerate(v)]
    bad = [(900, None, "x"), (901, [0.5] * (d - 1) + [None], "x"), (902, [NAN] * d, "x"), (903, [INF] * d, "x"), (904, [], "x"), (905, [1.0] * (d + 1), "x")]
    got = whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, whitened string"), components=components)
    out = sorted(got.collect(), key=lambda r: r.vec_id)
    k = min(components, d)
    deviations, white, explained = by_hand(v.tolist(), k)
    assert [r.vec_id for r in out] == list(range(n)) and {r.n for r in out} == {n}
    assert [r.deviation for r in out] == deviations
    assert same_up_to_sign(np.array([r.whitened for r in out]), white)
    assert np.allclose(out[0].explained, explained, rtol=1e-9) and out[0].identity_error < 1e-9
    long = by_component(got).collect()
    assert len(long) == n * k and {r.component for r in long} == set(range(1, k + 1))
    assert {(r.vec_id, r.component): r.whitened for r in long}[3, 2] == out[3].whitened[1]


def test_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    same = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(3, 0, [])] * 3
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25])], kind)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 1, 0, [], 0.0)]
    # one direction varies: one component, with repeated rows counted each
    flat = whiten(spark.createDataFrame([(i, [float(i % 2), 3.0]) for i in range(6)], kind)).collect()
    assert all(abs(abs(r.whitened[0]) - 1) < 1e-12 and len(r.whitened) == 1 and r.explained == [1.0] for r in flat)
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    assert by_component(whiten(spark.createDataFrame([(1, None)], kind))).collect() == []


def test_large_entries_stay_exact(spark):
    v = [[1e9, -3e9], [2.5e8, 1e3], [0.0, 7.0], [-1e9, 5.0]]
    out = sorted(whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect(), key=lambda r: r.vec_id)
    deviations, white, _ = by_hand(v, 2)
    assert [r.deviation for r in out] == [d if d < 1 << 63 else None for d in deviations]
    assert same_up_to_sign(np.array([r.whitened for r in out]), white)
    huge = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge if r.vec_id < 3} == {None} and all(math.isfinite(r.whitened[0]) for r in huge)


@pytest.mark.parametrize("values", [[5.0] * 40, [9.0, 9.0, 4.0] + [0.0] * 30, list(0.8 ** np.arange(50)), [1.0] * 3 + [1e-9] * 37])
def test_block_lanczos(values):
    """Equal eigenvalues and low rank break blocks down; restarts find the rest."""
    rng = np.random.default_rng(4)
    d = len(values)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    a = q * values @ q.T
    got, vectors, passes = block_lanczos(lambda b: a @ b, d, 8, float(np.trace(a)))
    assert np.allclose(got, sorted(values, reverse=True)[:8], atol=1e-11) and passes <= math.ceil(d / 12) + 1
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-11) and np.allclose(a @ vectors, vectors * got, atol=1e-10)


def test_orthogonal_replaces_what_is_lost():
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((10, 6)))[0]
    block = np.column_stack([basis[:, 0], basis[:, 1] + basis[:, 2], rng.standard_normal(10), np.zeros(10), np.zeros(10)])
    out = orthogonal(block, basis, rng, 1e-10)
    assert out.shape == (10, 4)
    full = np.column_stack([basis, out])
    assert np.allclose(full.T @ full, np.eye(10), atol=1e-12)
