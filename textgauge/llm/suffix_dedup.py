"""Suffix-array deduplication: remove bytes of repeated 100-byte strings.

Documents are dealt to buckets by id.  Inside a bucket:

* Anchors: of the 51 grams of 50 bytes in a 100-byte window, the one with the
  least hash (the leftmost of equals) anchors the window.  Equal windows have
  equal anchors, wherever they stand, so a window can only repeat where its
  anchor gram does; about one byte in 26 starts an anchor.
* First exchange: buckets send their distinct anchor hashes to hash owners, who
  answer unique, repeated always in one context, or repeated in several.
* Suffix sort: suffixes at repeated anchors are sorted by mergesort.  Two of them
  are compared by binary search for their common extension on prefix polynomial
  hashes; neighbours that compare equal are verified byte by byte.
* Second exchange: each class of equal strings sends a 128-bit digest and its
  first place, and learns whether an earlier place exists in another bucket.  Single
  windows whose contexts differ go out likewise, by two polynomial hashes of
  different bases and byte values.

Where buckets and owners are so many that a blob would hold next to nothing, both
exchanges go by relays, which merge what a slice of the buckets sends to a group of
owners (``exchange.Route``).

Hot strings: a bucket sends each hash or class once, so an owner sees it at most
once per bucket or relay, and strings in many contexts are spread by their own digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, POWERS2, PrefixHash, byte_table, exchange_sizes, keyed, mix, pieces, release, spread, texts
from .exchange import MOST_BLOBS, Route, exchange, pack, route, unpack

U64 = np.uint64
WINDOW, GRAM = 100, 50
_VALUES = byte_table()
#: Byte values of the second hash, whose base is another one too.
_VALUES2 = mix(byte_table() ^ U64(0x5851F42D4C957F2D))
#: A null doc_id is later than any other.
_LAST = np.iinfo(np.int64).max


# ------------------------------------------------------------------ anchors


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    out, done = a, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def _anchors_of(hashes: np.ndarray, windows: int, span: int):
    """Anchor, first and last window of each maximal run of windows with one anchor."""
    least = _sliding(hashes, span, np.minimum)[:windows]
    padded = np.concatenate([np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)])
    chosen = np.flatnonzero(hashes == _sliding(padded, span, np.maximum))
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    s0 = np.concatenate([[0], change])
    s1 = np.append(change - 1, windows - 1)
    value = least[s0]
    i = np.searchsorted(chosen, s0)
    size = np.searchsorted(chosen, s1 + span - 1, "right") - i
    seg = np.repeat(np.arange(len(s0)), size)
    at = chosen[spread(i, size)]
    same = hashes[at] == value[seg]
    seg, at = seg[same], at[same]
    start = s0[seg]
    follows = np.flatnonzero(seg[1:] == seg[:-1]) + 1
    start[follows] = np.maximum(start[follows], at[follows - 1] + 1)
    end = np.minimum(s1[seg], at)
    ok = start <= end
    return at[ok], start[ok], end[ok]


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Anchors of all windows of a bucket: place, first and last window start,
    gram hash and hash of the context (the bytes of all its windows)."""
    out = [[] for _ in range(5)]
    for i, j in pieces(offsets):
        base, own = offsets[i], data[offsets[i] : offsets[j]]
        windows = len(own) - window + 1
        if windows < 1:
            continue
        prefix = PrefixHash(own, _VALUES)
        grams = np.arange(len(own) - gram + 1)
        hashes = mix(prefix.of(grams, grams + gram))
        at, first, last = _anchors_of(hashes, windows, window - gram + 1)
        bounds = offsets[i : j + 1] - base
        doc = np.searchsorted(bounds, at, "right") - 1
        first = np.maximum(first, bounds[doc])
        last = np.minimum(last, bounds[doc + 1] - window)
        ok = first <= last
        at, first, last = at[ok], first[ok], last[ok]
        context = mix(prefix.of(first, last + window) + mix((at - first).astype(U64) * U64(4099) + (last - first).astype(U64)))
        # least hashes crowd at the low end, so they are mixed again to spread over the owners
        for k, x in enumerate((at + base, first + base, last + base, mix(hashes[at] + U64(1)), context)):
            out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64 if k < 3 else U64) for k, x in enumerate(out)]


# ------------------------------------------------------------------ suffix sort


class SuffixSorter:
    """Orders substrings by mergesort with hash-compared common extensions."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.prefix = PrefixHash(data, _VALUES)
        # the first eight bytes settle most comparisons
        head = np.zeros((len(start), 8), np.uint8)
        for k in range(8):
            inside = k < length
            head[inside, k] = data[start[inside] + k]
        self.head = head.view(">u8").ravel().astype(U64)
        self.most = int(length.max(initial=0))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that substrings a and b have in common at their starts."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.length[a], self.length[b])
        s, t, h = self.start[a], self.start[b], self.prefix.h
        ds, dt = POWERS.down(s), POWERS.down(t)
        hs, ht = h[s], h[t]
        for _ in range(self.most.bit_length()):
            mid = (low + high + 1) >> 1
            same = (h[s + mid] - hs) * ds == (h[t + mid] - ht) * dt
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether substring a sorts before b (or with it)."""
        out = self.head[a] < self.head[b]
        tie = np.flatnonzero(self.head[a] == self.head[b])
        if len(tie):
            x, y = a[tie], b[tie]
            n = self.extension(x, y)
            lx, ly = self.length[x], self.length[y]
            ended = n >= np.minimum(lx, ly)
            size = len(self.data)
            cx = self.data[np.minimum(self.start[x] + n, size - 1)]
            cy = self.data[np.minimum(self.start[y] + n, size - 1)]
            short = (lx <= ly) if or_equal else (lx < ly)
            out[tie] = np.where(ended, short, cx < cy)
        return out

    def order(self) -> np.ndarray:
        """Stable bottom-up mergesort; all merges of a level run at once."""
        n = len(self.start)
        items = np.arange(n)
        width = 1
        while width < n:
            place = np.arange(n)
            run = place // width
            left = run % 2 == 0
            base = (run // 2) * 2 * width
            # an element's rank in the sibling run
            low = np.where(left, np.minimum(base + width, n), base)
            high = np.where(left, np.minimum(base + 2 * width, n), base + width)
            first = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                mine, other = items[live], items[mid]
                l = left[live]
                # equals of the left run stay in front
                ahead = np.empty(len(live), bool)
                if l.any():
                    ahead[l] = self.before(other[l], mine[l], or_equal=False)
                if not l.all():
                    ahead[~l] = self.before(other[~l], mine[~l], or_equal=True)
                low[live] = np.where(ahead, mid + 1, low[live])
                high[live] = np.where(ahead, high[live], mid)
                live = live[low[live] < high[live]]
            target = base + (place - run * width) + (low - first)
            merged = np.empty(n, items.dtype)
            merged[target] = items
            items, width = merged, width * 2
        return items

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order, and for each place in it whether a new class begins there.

        Neighbours whose hashes agree are compared byte by byte; should one pair
        differ, the substrings themselves are sorted instead.
        """
        order = self.order()
        new = np.ones(len(order), bool)
        if len(order) < 2:
            return order, new
        a, b = order[:-1], order[1:]
        equal = self.length[a] == self.length[b]
        at = np.flatnonzero(equal)
        equal[at] = self.extension(a[at], b[at]) == self.length[a[at]]
        for block in np.array_split(np.flatnonzero(equal), max(1, int(equal.sum()) >> 13)):
            x, y, n = self.start[a[block]], self.start[b[block]], self.length[a[block]]
            if (self.data[spread(x, n)] != self.data[spread(y, n)]).any():
                raw = self.data.tobytes()
                keys = [raw[s : s + k] for s, k in zip(self.start.tolist(), self.length.tolist(), strict=True)]
                order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], i)), np.int64)
                new[1:] = [keys[p] != keys[q] for p, q in zip(order[:-1], order[1:], strict=True)]
                return order, new
        new[1:] = ~equal
        return order, new


# ------------------------------------------------------------------ exchanges

_ROW = "target int, source int, kind int, a binary, b binary, c binary, d binary"
_UNIQUE, _ONE_CONTEXT, _CONTEXTS = 0, 1, 2
_GRAMS, _PLAN, _REPLY = 0, 1, 2
_NAMES = ["target", "source", "kind", "a", "b", "c", "d"]


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


class _Bucket:
    """A bucket's documents in the order of their ids."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").to_pylist()
        names = docs.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, names[i] or ""))
        docs = docs.take(pa.array(order, pa.int64()))
        self.ids = docs.column("doc_id").combine_chunks()
        self.data, self.offsets = texts(docs.column("text"))
        release()
        self.keys = np.array([_LAST if i is None else i for i in docs.column("doc_id").to_pylist()], np.int64)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def _records(source: int, parts: dict, keys, extra, docs):
    """Blobs of (128 bit key, first document) for each address; the keys' first halves ascend."""
    for target, (x, z) in parts.items():
        table, ordinal = np.unique(docs[x:z], return_inverse=True)
        yield (target, source, _GRAMS, keys[x:z].tobytes(), extra[x:z].tobytes(), ordinal.astype(np.uint16 if len(table) < 65536 else np.uint32).tobytes(), table.tobytes())


class _Claims:
    """Keys that blobs hold, each with the first of its places."""

    def __init__(self, rows):
        self.source, keys, extra, docs = [], [], [], []
        for s, a, b, c, d in zip(*(rows.column(n).to_pylist() for n in ("source", "a", "b", "c", "d")), strict=True):
            table = np.frombuffer(d, np.int64)
            self.source.append(s)
            keys.append(np.frombuffer(a, U64))
            extra.append(np.frombuffer(b, U64))
            docs.append(table[np.frombuffer(c, np.uint16 if len(table) < 65536 else np.uint32)])
        size = np.array([len(k) for k in keys])
        k, e, d, s = np.concatenate(keys), np.concatenate(extra), np.concatenate(docs), np.repeat(self.source, size)
        order = np.lexsort((s, d, e, k))
        new = np.ones(len(order), bool)
        new[1:] = (k[order[1:]] != k[order[:-1]]) | (e[order[1:]] != e[order[:-1]])
        self.cuts = np.concatenate([[0], np.cumsum(size)])
        #: Place of the first claim of each key, and the claims themselves.
        self.first = order[new]
        self.keys, self.extra, self.docs = k[self.first], e[self.first], d[self.first]

    def replies(self, own: int, wins: np.ndarray) -> pa.Table:
        """A bitmap for each blob: which of its claims are first, where the key's ``wins`` is set."""
        bits = np.zeros(self.cuts[-1], np.uint8)
        bits[self.first[wins]] = 1
        return _rows([(t, own, _REPLY, pack(np.packbits(bits[self.cuts[i] : self.cuts[i + 1]])), b"", b"", b"") for i, t in enumerate(self.source)])


def _settle(key, rows):
    """Owner: for every key, which bucket holds its first place.  Rows that are
    addressed to a bucket pass through."""
    if key[0].as_py() >= 0:
        return rows.select(_NAMES)
    claims = _Claims(rows)
    release()
    return claims.replies(key[0].as_py(), np.ones(len(claims.keys), bool))


def _merge_claims(way: Route):
    def run(key, rows):
        relay = key[0].as_py()
        if relay >= 0:
            return _rows([])
        claims = _Claims(rows)
        return _rows(list(_records(relay, way.relayed(relay, claims.keys), claims.keys, claims.extra, claims.docs)))

    return run


def _answer_claims(way: Route):
    def run(key, rows, replies):
        relay = key[0].as_py()
        if relay >= 0 or not rows.num_rows:
            return rows.select(_NAMES)
        claims = _Claims(rows)
        return claims.replies(relay, _wins(replies.to_pylist(), way.relayed(relay, claims.keys), len(claims.keys)))

    return run


def _wins(replies: list[dict], parts: dict, n: int) -> np.ndarray:
    """The replies' bits for n keys that went out in these parts, in the keys' order."""
    out = np.zeros(n, bool)
    for r in replies:
        x, z = parts[r["source"]]
        out[x:z] = np.unpackbits(unpack(r["a"], np.uint8), count=z - x) > 0
    return out


def _distinct(hashes: np.ndarray):
    """Distinct anchor hashes with their smallest and largest context and count."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return order, h[start], start


def _anchor_rows(source: int, parts: dict, h, low, state) -> list[tuple]:
    short = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 2:]  # the upper 48 bits
    return [(target, source, _GRAMS, short[x:z].tobytes(), low[x:z].tobytes(), pack(state[x:z]), b"") for target, (x, z) in parts.items()]


def _send_anchors(way: Route):
    def run(key, docs):
        b = _Bucket(docs)
        _, _, _, grams, context = anchors(b.data, b.offsets)
        order, h, start = _distinct(grams)
        if not len(h):
            return _rows([])
        c = context[order]
        low, high = np.minimum.reduceat(c, start), np.maximum.reduceat(c, start)
        # repeated here, and in several contexts here
        here = (np.diff(np.append(start, len(order))) > 1).astype(np.uint8) + (low != high)
        bucket = key[0].as_py()
        return _rows(_anchor_rows(bucket, way.parts(bucket, h), h, low, here))

    return run


class _Rated:
    """Anchor hashes that blobs hold: distinct ones, ascending, with a context and a state."""

    def __init__(self, rows):
        self.source, hs, lows, states = rows.column("source").to_pylist(), [], [], []
        for a, b, c in zip(*(rows.column(n).to_pylist() for n in "abc"), strict=True):
            full = np.zeros((len(a) // 6, 8), np.uint8)
            full[:, 2:] = np.frombuffer(a, np.uint8).reshape(-1, 6)
            hs.append(full.view(U64).ravel())
            lows.append(np.frombuffer(b, U64))
            states.append(unpack(c, np.uint8))
        self.cuts = np.concatenate([[0], np.cumsum([len(h) for h in hs])])
        h, low, state = np.concatenate(hs), np.concatenate(lows), np.concatenate(states)
        self.order = order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        self.group = np.diff(np.append(start, len(order)))
        l, s = low[order], np.maximum.reduceat(state[order], start)
        self.hashes, self.low = h[order][start], np.minimum.reduceat(l, start)
        several = (self.low != np.maximum.reduceat(l, start)) | (s == _CONTEXTS)
        self.state = np.where(several, _CONTEXTS, np.where((self.group > 1) | (s > 0), _ONE_CONTEXT, _UNIQUE)).astype(np.uint8)

    def replies(self, own: int, state: np.ndarray) -> pa.Table:
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = np.repeat(state, self.group)
        return _rows([(t, own, _REPLY, pack(out[self.cuts[i] : self.cuts[i + 1]]), b"", b"", b"") for i, t in enumerate(self.source)])


def _rate_anchors(key, rows):
    """Owner: whether each anchor hash is unique, repeated in one context or in several."""
    rated = _Rated(rows)
    return rated.replies(key[0].as_py(), rated.state)


def _merge_anchors(way: Route):
    def run(key, rows):
        rated, relay = _Rated(rows), key[0].as_py()
        return _rows(_anchor_rows(relay, way.relayed(relay, rated.hashes), rated.hashes, rated.low, rated.state))

    return run


def _states(replies: list[dict], parts: dict, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for r in replies:
        x, z = parts[r["source"]]
        out[x:z] = unpack(r["a"], np.uint8)
    return out


def _answer_anchors(way: Route):
    def run(key, rows, replies):
        if not rows.num_rows:
            return _rows([])
        rated, relay = _Rated(rows), key[0].as_py()
        return rated.replies(relay, _states(replies.to_pylist(), way.relayed(relay, rated.hashes), len(rated.hashes)))

    return run


def _send_contexts(way: Route):
    """Suffix-sort the repeated anchors' contexts and send each class once."""

    def run(key, docs, replies):
        if not docs.num_rows or not replies.num_rows:
            return _rows([])
        bucket, b = key[0].as_py(), _Bucket(docs)
        _, first, last, grams, _ = anchors(b.data, b.offsets)
        order, h, start = _distinct(grams)
        state = _states(replies.to_pylist(), way.parts(bucket, h), len(h))
        each = np.empty(len(order), np.uint8)
        each[order] = np.repeat(state, np.diff(np.append(start, len(order))))
        some = np.flatnonzero(each)
        if not len(some):
            return _rows([])
        some = some[np.argsort(first[some], kind="stable")]
        begin, length, windows = first[some], last[some] - first[some] + WINDOW, last[some] - first[some] + 1
        sorted_at, new = SuffixSorter(b.data, begin, length).classes()
        number = np.cumsum(new) - 1
        # mergesort is stable, so a class begins with its first place
        heads = sorted_at[new]
        digests = [xxhash.xxh3_128_intdigest(b.data[s : s + n]) for s, n in zip(begin[heads], length[heads], strict=True)]
        keys = np.array([x & 0xFFFFFFFFFFFFFFFF for x in digests], U64)
        extra = np.array([x >> 64 for x in digests], U64)
        by_key = np.argsort(keys, kind="stable")
        place = np.empty(len(by_key), np.int32)
        place[by_key] = np.arange(len(by_key))
        of = np.empty(len(some), np.int32)
        of[sorted_at] = place[number]
        head = np.zeros(len(some), bool)
        head[heads] = True
        flags = (head + 2 * (each[some] == _CONTEXTS)).astype(np.uint8)
        out = list(_records(bucket, way.parts(bucket, keys[by_key]), keys[by_key], extra[by_key], b.keys[b.doc(begin[heads[by_key]])]))
        flat = pack(flags)
        out.append((bucket, 0, _PLAN, pack(np.diff(begin, prepend=0).astype(np.int32)), pack(windows.astype(np.uint8)), pack(of), len(flat).to_bytes(8, "little") + flat + keys[by_key].tobytes()))
        return _rows(out)

    return run


class _Plan:
    """What a bucket knows after the context exchange."""

    def __init__(self, bucket: int, rows: list[dict], way: Route):
        plan = next(r for r in rows if r["kind"] == _PLAN)
        n = int.from_bytes(plan["d"][:8], "little")
        self.begin = np.cumsum(unpack(plan["a"], np.int32).astype(np.int64))
        self.windows = unpack(plan["b"], np.uint8).astype(np.int64)
        flags = unpack(plan["d"][8 : 8 + n], np.uint8)
        keys = np.frombuffer(plan["d"][8 + n :], U64)
        wins = _wins([r for r in rows if r["kind"] == _REPLY], way.parts(bucket, keys), len(keys))
        first = ((flags & 1) > 0) & wins[unpack(plan["c"], np.int32)]
        #: Later occurrences of a context: all their windows go.
        self.later = ~first
        #: First occurrences whose gram stands in several contexts: their windows are compared one by one.
        self.open = np.flatnonzero(first & (flags > 1))


def _windows_of(b: _Bucket, begin: np.ndarray, windows: np.ndarray):
    """Window starts with their keys; sorted distinct keys with their first place."""
    at = np.sort(spread(begin, windows))
    h = mix(PrefixHash(b.data, _VALUES).of(at, at + WINDOW))
    x = mix(PrefixHash(b.data, _VALUES2, POWERS2).of(at, at + WINDOW))
    order = np.lexsort((x, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (x[order[1:]] != x[order[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    head = order[new]
    return at, of, head, h[head], x[head]


def _send_windows(way: Route):
    def run(key, docs, rows):
        if not docs.num_rows or not rows.num_rows:
            return _rows([])
        bucket, b = key[0].as_py(), _Bucket(docs)
        p = _Plan(bucket, rows.to_pylist(), way)
        out = []
        later = p.later
        decided = pack(np.diff(p.begin[later], prepend=0).astype(np.int32)), pack(p.windows[later].astype(np.uint8))
        openly = pack(np.diff(p.begin[p.open], prepend=0).astype(np.int32)), pack(p.windows[p.open].astype(np.uint8))
        if len(p.open):
            at, _, head, keys, extra = _windows_of(b, p.begin[p.open], p.windows[p.open])
            out += _records(bucket, way.parts(bucket, keys), keys, extra, b.keys[b.doc(at[head])])
        out.append((bucket, 0, _PLAN, *decided, *openly))
        return _rows(out)

    return run


def _finish(way: Route):
    def run(key, docs, rows):
        b = _Bucket(docs)
        starts = ends = np.zeros(0, np.int64)
        plan = next((r for r in rows.to_pylist() if r["kind"] == _PLAN), None)
        if plan is not None and docs.num_rows:
            begin = np.cumsum(unpack(plan["a"], np.int32).astype(np.int64))
            windows = unpack(plan["b"], np.uint8).astype(np.int64)
            open_begin = np.cumsum(unpack(plan["c"], np.int32).astype(np.int64))
            if len(open_begin):
                at, of, head, keys, _ = _windows_of(b, open_begin, unpack(plan["d"], np.uint8).astype(np.int64))
                wins = _wins([r for r in rows.to_pylist() if r["kind"] == _REPLY], way.parts(key[0].as_py(), keys), len(keys))
                stays = np.zeros(len(at), bool)
                stays[head] = wins
                begin = np.concatenate([begin, at[~stays]])
                windows = np.concatenate([windows, np.ones(int((~stays).sum()), np.int64)])
            starts, ends = begin, begin + windows - 1 + WINDOW
        doc, runs_s, runs_e = b.doc(starts), [], []
        o = np.lexsort((starts, doc))
        doc, starts, ends = doc[o], starts[o], ends[o]
        cut = np.searchsorted(doc, np.arange(docs.num_rows + 1))
        for d in range(docs.num_rows):
            x, z = cut[d], cut[d + 1]
            if x == z:
                runs_s.append([])
                runs_e.append([])
                continue
            s, e = starts[x:z], np.maximum.accumulate(ends[x:z])
            new = np.ones(z - x, bool)
            new[1:] = s[1:] > e[:-1]
            at = np.flatnonzero(new)
            runs_s.append((s[at] - b.offsets[d]).tolist())
            runs_e.append((e[np.append(at[1:] - 1, z - x - 1)] - b.offsets[d]).tolist())
        n_bytes, removed, spans, sha = [], [], [], []
        for d in range(docs.num_rows):
            own = b.data[b.offsets[d] : b.offsets[d + 1]]
            kept, last = hashlib.sha256(), 0
            for s, e in zip(runs_s[d], runs_e[d], strict=True):
                kept.update(own[last:s])
                last = e
            kept.update(own[last:])
            n_bytes.append(len(own))
            removed.append(sum(e - s for s, e in zip(runs_s[d], runs_e[d], strict=True)))
            spans.append(len(runs_s[d]))
            sha.append(kept.hexdigest())
        return pa.table(
            {
                "doc_id": b.ids,
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "starts": pa.array(runs_s, pa.list_(pa.int64())),
                "ends": pa.array(runs_e, pa.list_(pa.int64())),
            }
        )

    return run


def repeated_spans(docs: DataFrame, buckets: int | None = None, owners: int | None = None, most_blobs: int = MOST_BLOBS) -> DataFrame:
    """Byte runs of each document that repeat an earlier 100-byte string.

    Earlier is a smaller doc_id, or an earlier start in the same document; rows
    that share a doc_id are ordered by their texts, and a null doc_id is later
    than any other.  Strings are judged on the input.  Returns one row per input
    row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs
    as byte offsets ``starts`` and ``ends`` (exclusive).  Null or short texts
    have no runs.  A run may begin or end inside a multi-byte character, as the
    rule is about bytes.  Other columns are ignored.  Beyond ``most_blobs`` blobs
    the exchanges go by relays; the result is the same.
    """
    docs = keyed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0 if buckets is None or owners is None else 0
    buckets, owners = exchange_sizes(docs.sparkSession, int(size), buckets, owners)
    way = route(buckets, owners, most_blobs)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    docs = docs.select(F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")
    dealt = docs.groupBy("bucket")
    grams = dealt.applyInArrow(_send_anchors(way), _ROW)
    rated = exchange(grams, way, _rate_anchors, _merge_anchors(way), _answer_anchors(way), _ROW)
    contexts = dealt.cogroup(rated.groupBy("target")).applyInArrow(_send_contexts(way), _ROW)
    settled = exchange(contexts, way, _settle, _merge_claims(way), _answer_claims(way), _ROW)
    windows = dealt.cogroup(settled.groupBy("target")).applyInArrow(_send_windows(way), _ROW)
    judged = exchange(windows, way, _settle, _merge_claims(way), _answer_claims(way), _ROW)
    return dealt.cogroup(judged.groupBy("target")).applyInArrow(
        _finish(way), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"
    )
