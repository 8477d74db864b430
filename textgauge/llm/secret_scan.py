"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

The patterns' matches (kinds ``assign``, ``access``, ``hex``) always stand.  The battery
adds spans of kind ``random``: runs of letters, digits and ``+/_-`` that look like
drawn keys and not like text.

1. A run's encoding is the smallest alphabet that holds all its characters.
2. Three tests ask whether its symbols can be independent draws from that alphabet: a
   chi-squared test of uniformity (two-sided, as listed alphabets are too even), a runs
   test above and below the alphabet's middle, and the serial correlation of neighbours.
   A run that one of them rejects at ``LEVEL`` / 3 is no key.
3. Short runs pass such tests by chance, words too.  So a run's p-value is that of
   the opposite question: how likely text of this length, whose letters repeat as in
   prose (``PROSE``), would be as even as that.  It falls with the length, and most for
   large alphabets.
4. False discoveries are controlled over the whole corpus for each encoding and
   doubling of length apart (Benjamini and Hochberg, on p-values rounded up to powers of
   two), so that many short words don't hide a few long keys.

One scan counts p-values, a table of bounded size; a second one marks spans.  Texts
are never shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import byte_set, keyed, pieces, spread, texts, word_runs

# The patterns, and how long a match has to be.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

#: Shortest run that is tested, level of the battery, and the accepted share of false discoveries.
SHORTEST, LEVEL, FALSE_SHARE = 20, 0.01, 0.01
#: How often two letters of English prose are equal (its index of coincidence), and the same of
#: its letters a to f alone.
PROSE, PROSE_HEX = 0.0667, 0.26
#: p-values count as powers of two up to this one.
BITS = 64

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, smallest alphabet first: name, alphabet, how often symbols of text are equal.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef", PROSE_HEX),
    ("hex upper", _DIGITS + "ABCDEF", PROSE_HEX),
    ("lower", _LOWER, PROSE),
    ("upper", _UPPER, PROSE),
    ("base32", _UPPER + "234567", PROSE),
    ("base36", _DIGITS + _LOWER, PROSE),
    ("base36 upper", _DIGITS + _UPPER, PROSE),
    ("base62", _UPPER + _LOWER + _DIGITS, PROSE),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", PROSE),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", PROSE),
]
_SIZE = np.array([len(a) for _, a, _ in ENCODINGS])
_REPEAT = np.array([r for _, _, r in ENCODINGS])
_SYMBOL = np.zeros((len(ENCODINGS), 256), np.int64)
#: Bit e of a byte is set where encoding e does not hold it.
_LACKS = np.zeros(256, np.uint16)
for _e, (_, _alphabet, _) in enumerate(ENCODINGS):
    _at = np.frombuffer(_alphabet.encode(), np.uint8)
    _SYMBOL[_e, _at] = np.arange(len(_at))
    _LACKS |= np.where(np.isin(np.arange(256), _at), 0, 1 << _e).astype(np.uint16)
_HEX = byte_set(digits=(48, 57), letters=(97, 102))
_RUN = byte_set(digits=(48, 57), capitals=(65, 90), letters=(97, 122), plus=(43, 43), minus=(45, 45), slash=(47, 47), underscore=(95, 95))
_erfc = np.vectorize(math.erfc, otypes=[float])


def _normal(z: np.ndarray) -> np.ndarray:
    """Lower tail of the normal distribution."""
    return 0.5 * _erfc(-z / math.sqrt(2))


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
    """Matches of the patterns: (document, kind, start, end), bytes of ``data``."""
    whole = data.tobytes()
    low, out = whole.lower(), []
    start, end, _ = word_runs(data, offsets, _HEX)
    long = end - start >= LEAST["hex"]
    out += [(d, "hex", a, z) for d, a, z in zip(_document(offsets, start[long]), start[long].tolist(), end[long].tolist(), strict=True)]
    if any(k in low for k in _KEYWORDS) or b"AKIA" in whole:
        for d, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(low.find(k, a, z) >= 0 for k in _KEYWORDS):
                out += [(d, "assign", a + m.start(), a + m.end()) for m in ASSIGN.finditer(whole[a:z]) if len(m[1]) >= LEAST["assign"]]
            if whole.find(b"AKIA", a, z) >= 0:
                out += [(d, "access", a + m.start(), a + m.end()) for m in ACCESS.finditer(whole[a:z]) if len(m[0]) >= LEAST["access"]]
    return out


def _document(offsets: np.ndarray, at: np.ndarray) -> list[int]:
    return (np.searchsorted(offsets, at, "right") - 1).tolist()


def _apart(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, str, int, int]]) -> np.ndarray:
    """Which of the ascending runs meet none of the spans."""
    met = np.zeros(len(start) + 1, np.int64)
    for _, _, a, z in spans:
        met[np.searchsorted(end, a, "right")] += 1
        met[max(np.searchsorted(end, a, "right"), np.searchsorted(start, z, "left"))] -= 1
    return np.cumsum(met[:-1]) == 0


def battery(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoding of each run (-1: none), and the p-value of text being as even, 1 where a
    test of randomness rejects the run."""
    n, total = end - start, len(start)
    encoding, p = np.full(total, -1), np.ones(total)
    if not total:
        return encoding, p
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    bytes_ = data[spread(start, n)]
    lacks = np.bitwise_or.reduceat(_LACKS[bytes_], first)
    holds = (lacks[:, None] >> np.arange(len(ENCODINGS), dtype=np.uint16)) & 1 == 0
    # runs of digits alone belong to no encoding: numbers are as even as keys
    digits = np.logical_and.reduceat((bytes_ >= 48) & (bytes_ <= 57), first)
    encoding = np.where(holds.any(axis=1) & ~digits, holds.argmax(axis=1), -1)
    own = np.repeat(np.arange(total), n)
    e = np.maximum(encoding, 0)
    k, size = _SIZE[e].astype(float), n.astype(float)
    symbol = _SYMBOL[e[own], bytes_]
    width = int(_SIZE.max())
    seen = np.bincount(own * width + symbol, minlength=total * width).reshape(total, width)
    even = (seen.astype(float) ** 2).sum(axis=1) * k / size - size
    # chi-squared, by Wilson and Hilferty, with the variance of so many draws
    spread_z = (np.cbrt(np.maximum(even, 0) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / np.sqrt(2 / (9 * (k - 1)) * (size - 1) / size)
    # runs above and below the middle
    above = symbol >= (k / 2)[own]
    turn = np.concatenate([[0], (above[1:] != above[:-1]) & (own[1:] == own[:-1])])
    runs, high = 1 + np.add.reduceat(turn, first), np.add.reduceat(above.astype(np.int64), first).astype(float)
    mean = 2 * high * (size - high) / size + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        runs_z = (runs - mean) / np.sqrt((mean - 1) * (mean - 2) / (size - 1))
        # neighbours
        off = symbol - (np.add.reduceat(symbol, first) / size)[own]
        product = np.concatenate([off[1:] * off[:-1] * (own[1:] == own[:-1]), [0.0]])
        serial_z = (np.add.reduceat(product, first) / np.add.reduceat(off * off, first) + 1 / size) * np.sqrt(size)
    random = (encoding >= 0) & (mean > 2)
    for z in (spread_z, runs_z, serial_z):
        random &= 2 * _normal(-np.abs(np.nan_to_num(z, nan=np.inf))) >= LEVEL / 3
    # text's evenness: so many degrees of freedom and what repeats beyond them
    extra = size * (k * _REPEAT[e] - 1)
    p = np.where(random, _normal((even - (k - 1 + extra)) / np.sqrt(2 * (k - 1) + 4 * extra)), 1.0)
    return encoding, p


def _bits(p: np.ndarray) -> np.ndarray:
    """Powers of two that p-values round up to: p <= 2**-bits."""
    return np.clip(np.floor(-np.log2(np.maximum(p, 2.0**-BITS))), 0, BITS).astype(int)


def _candidates(data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, str, int, int]]):
    """Runs beside the patterns' matches: starts, ends, strata and bits."""
    start, end, _ = word_runs(data, offsets, _RUN)
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    free = _apart(start, end, base)
    start, end = start[free], end[free]
    encoding, p = battery(data, start, end)
    known = encoding >= 0
    start, end = start[known], end[known]
    # an encoding and a doubling of length
    stratum = encoding[known] * 64 + np.floor(np.log2(np.maximum(end - start, 1))).astype(int)
    return start, end, stratum, _bits(p[known])


def thresholds(counts: dict[tuple[int, int], int], share: float) -> dict[int, int]:
    """Least bits that make a discovery, by stratum, from counts by (stratum, bits)."""
    out = {}
    for s in sorted({s for s, _ in counts}):
        mine = np.array([counts.get((s, b), 0) for b in range(BITS + 1)])
        found = np.cumsum(mine[::-1])[::-1]
        good = np.flatnonzero((found > 0) & (mine.sum() * 2.0 ** -np.arange(BITS + 1) <= share * found))
        if len(good):
            out[s] = int(good[0])
    return out


def _points(part: np.ndarray, at: list[int]) -> list[int]:
    """Byte positions in a document as code points."""
    if not at:
        return []
    later = np.concatenate([[0], np.cumsum((part & 0xC0) == 0x80)])
    return [int(x - later[x]) for x in at]


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Spans of secrets in every text: doc_id, spans (kind, start, end) in code points,
    ends exclusive, by start and then kind.

    Takes ``doc_id`` and ``text``; other columns are ignored.  ``share`` of the spans of
    kind ``random`` may be text, in expectation over the whole table for each encoding and
    doubling of length; runs that a pattern's match meets are not tested.  Null and empty
    texts have no spans; repeated rows and null ids are rows like any other (and count as
    often among the p-values); an empty table stays empty.
    """
    docs = spread_rows(keyed(docs, "doc_id", "text"))

    def count(batches):
        for b in batches:
            data, offsets = texts(b.column(0))
            for i, j in pieces(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, stratum, bits = _candidates(part, cut, base_spans(part, cut))
                keys, n = np.unique(stratum * (BITS + 1) + bits, return_counts=True)
                yield pa.RecordBatch.from_pydict({"stratum": pa.array(keys // (BITS + 1), pa.int32()), "bits": pa.array(keys % (BITS + 1), pa.int32()), "n": pa.array(n, pa.int64())})

    seen = docs.select("text").mapInArrow(count, "stratum int, bits int, n bigint").groupBy("stratum", "bits").agg(F.sum("n").alias("n"))
    least = thresholds({(r.stratum, r.bits): r.n for r in seen.collect()}, share)

    def mark(batches):
        for b in batches:
            data, offsets = texts(b.column(1))
            spans: list[list[dict]] = [[] for _ in range(len(b))]
            for i, j in pieces(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = base_spans(part, cut)
                start, end, stratum, bits = _candidates(part, cut, found)
                hit = np.array([x >= least.get(s, BITS + 1) for s, x in zip(stratum.tolist(), bits.tolist(), strict=True)], bool)
                found += [(d, "random", a, z) for d, a, z in zip(_document(cut, start[hit]), start[hit].tolist(), end[hit].tolist(), strict=True)]
                found.sort(key=lambda s: (s[0], s[2], KINDS.index(s[1])))
                at: dict[int, list] = {}
                for s in found:
                    at.setdefault(s[0], []).append(s)
                for d, own in at.items():
                    points = _points(part[cut[d] : cut[d + 1]], [x - int(cut[d]) for s in own for x in s[2:]])
                    spans[i + d] = [{"kind": s[1], "start": a, "end": z} for s, a, z in zip(own, points[::2], points[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(mark, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans of ``find_secrets``."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(of, KINDS[:3]), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))
