import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from textgauge.llm import suffix_dedup
from textgauge.llm.exact_dedup import exact_dedup
from textgauge.llm.exchange import Route, golomb, route, ungolomb
from textgauge.llm.suffix_dedup import SuffixSorter, repeated_spans


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, norm string")


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 5000):
        v = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (ungolomb(golomb(v)) == v).all()
    v = np.array([0, 1, 2, 2**64 - 1], np.uint64)
    assert (ungolomb(golomb(v)) == v).all()


def test_exact_dedup_edges(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50000), (8, "X" * 50000), (9, "solo"), (9, "solo"), (None, "abc"), (None, "lone")]
    rows += [(100 + i, "hot") for i in range(50)]
    got = exact_dedup(frame(spark, [(*r, "a", "b") for r in rows])).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    for i, t in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        # of rows that repeat an id and its text one is kept
        again = (i, keep, len(ids), True, hashlib.sha256(lower(t).encode()).hexdigest()) in want
        want.append((i, keep, len(ids), i == keep and not again, hashlib.sha256(lower(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[3])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(frame(spark, [])).count() == 0
    # a Bloom filter that lets everything through changes nothing
    again = exact_dedup(frame(spark, [(*r, "a", "b") for r in rows]), filter_bytes=1).collect()
    assert sorted(map(tuple, again), key=key) == sorted(want, key=key)


def test_suffix_order_matches_bytes():
    random.seed(3)
    data = bytes(random.choice(b"ab") for _ in range(400)) + b"ab" * 100
    arr = np.frombuffer(data, np.uint8)
    start = np.array(random.choices(range(500), k=300))
    length = np.array([random.randint(1, 90) for _ in start])
    order, new = SuffixSorter(arr, start, length).classes()
    keys = [data[s : s + n] for s, n in zip(start, length, strict=True)]
    assert list(order) == sorted(range(len(keys)), key=lambda i: (keys[i], i))
    assert [keys[i] for i in order[new]] == sorted(set(keys))


def brute_spans(rows, window=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeated_spans_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(80)
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 80):
        kind = rng.randint(0, 5)
        if kind == 0:
            t = text(10) + " " + passage + " " + text(10)
        elif kind == 1:
            w = base.split()
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = base
        elif kind == 3:
            t = "na " * rng.randint(0, 200)
        elif kind == 4:
            t = passage[rng.randint(0, 50) :] + passage[: rng.randint(0, 250)]
        else:
            t = rng.choice(rows)[1]
        rows.append((i, t))
    rows += [(90, None), (91, ""), (92, "x" * 99), (93, "x" * 100), (94, "x" * 5000), (90, base), (None, base), (40, rows[40][1])]
    rng.shuffle(rows)
    got = repeated_spans(frame(spark, [(*r, "a", "b") for r in rows])).drop("starts", "ends").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute_spans(rows), key=key)
    # the same by relays: 9 owners in 3 groups, 11 buckets in 4 slices
    again = repeated_spans(frame(spark, [(*r, "a", "b") for r in rows]), 11, 7, most_blobs=1).drop("starts", "ends").collect()
    assert sorted(map(tuple, again), key=key) == sorted(brute_spans(rows), key=key)


def test_routes_agree_on_their_parts():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    assert route(10, 10, 100).direct and not route(10, 11, 100).direct
    for buckets, owners in ((11, 7), (1000, 1000), (3, 1), (2, 2)):
        way = route(buckets, owners, 0)
        assert way.owners >= owners and way.owners % way.groups == 0
        assert max(way.groups, way.owners // way.groups) <= owners**0.5 + 1 and way.slices <= buckets**0.5 + 1
        direct = Route(way.owners, way.owners, 1).parts(0, keys)
        for bucket in (0, buckets - 1):
            # a bucket's parts, cut again by their relays, are the direct ones
            found = {}
            for relay, (x, z) in way.parts(bucket, keys).items():
                found.update({t: (x + a, x + b) for t, (a, b) in way.relayed(relay, keys[x:z]).items()})
            assert found == direct


def test_repeated_spans_empty(spark):
    assert repeated_spans(frame(spark, [])).count() == 0


def test_sizes_follow_the_bytes(spark):
    from textgauge.llm.common import BUCKET_BYTES, OWNER_BYTES, exchange_sizes

    assert exchange_sizes(spark, 0, None, None) == (16, 2)
    assert exchange_sizes(spark, 10**12, None, None) == (-(-(10**12) // BUCKET_BYTES), -(-(10**12) // OWNER_BYTES))
    assert exchange_sizes(spark, 10**12, 3, 5) == (3, 5)


def test_filter_holds_every_suspect(spark):
    import hashlib

    from textgauge.llm.exact_dedup import _filter, _fingerprint, _probes

    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    df = spark.createDataFrame([(d.hex(),) for d in digests * 2], "text_sha256 string")
    for most in (1, 100, 1 << 20):
        at = _filter(df, most)
        p = _probes(np.array([_fingerprint(d) for d in digests], np.uint64), len(at) * 8)
        assert ((at[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all()
        assert len(at) <= max(most, 128)
    other = np.array([_fingerprint(hashlib.sha256(f"x{k}".encode()).digest()) for k in range(20000)], np.uint64)
    p = _probes(other, len(at) * 8)
    assert ((at[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1).mean() < 0.01


def test_contexts_that_share_half_their_bits(spark, monkeypatch):
    """An anchor's contexts that differ only in the lower half of their hashes are several."""
    rng = random.Random(13)
    shared = "".join(rng.choice("abcdefgh") for _ in range(128))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(60)) + shared[: 128 - i % 2] + "".join(rng.choice("qrstuvwx") for _ in range(60))) for i in range(8)]
    real = suffix_dedup.anchors

    def halved(*a, **k):
        *rest, context = real(*a, **k)
        return [*rest, context & np.uint64(0xFFFFFFFF)]

    monkeypatch.setattr(suffix_dedup, "anchors", halved)
    got = {r.doc_id: r.n_removed for r in repeated_spans(frame(spark, [(*r, "a", "b") for r in rows]), buckets=4, owners=3).collect()}
    assert got == {r[0]: r[2] for r in brute_spans(rows)} and any(got.values())
