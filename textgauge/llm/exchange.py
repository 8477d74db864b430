"""Compressed fingerprint exchange between document buckets and hash owners.

A bucket sorts its distinct 64-bit fingerprints and cuts them into ranges, one
for each owner; a range travels as one Golomb-Rice or delta coded blob.  An
owner sees each fingerprint once for each bucket at most, however often it
occurs, and answers every blob with a short array in the blob's own order.

Directly there is a blob for each bucket and owner.  Where these would be too many
and too small, owners form groups and buckets slices, and a relay for each group
and slice merges what its buckets send: it is an owner to them and a bucket to the
owners of its group.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

U64 = np.uint64


def owner_cuts(sorted_hashes: np.ndarray, owners: int) -> np.ndarray:
    """Positions that cut sorted fingerprints into equal ranges of the 64-bit space."""
    edges = np.array([(k << 64) // owners for k in range(1, owners)], U64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges, "left"), [len(sorted_hashes)]])


#: Blobs between buckets and owners beyond which relays stand between them: sizes that
#: follow the bytes reach it at about 1 TB of text, with about a kilobyte in a blob.
MOST_BLOBS = 1 << 29


class Route(NamedTuple):
    """Addresses of an exchange.  Buckets are 0, 1, ...; owners and relays are -1, -2, ..."""

    owners: int
    groups: int
    slices: int

    @property
    def direct(self) -> bool:
        return self.groups == self.owners

    def parts(self, bucket: int, keys: np.ndarray) -> dict[int, tuple[int, int]]:
        """Where a bucket's ascending keys go: ranges by address, empty ones left out."""
        cuts = owner_cuts(keys, self.groups).tolist()
        return {-1 - (k * self.slices + bucket % self.slices): (x, z) for k, (x, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < z}

    def relayed(self, relay: int, keys: np.ndarray) -> dict[int, tuple[int, int]]:
        """Where a relay's ascending keys go: ranges by owner."""
        size = self.owners // self.groups
        first = (-1 - relay) // self.slices * size
        edges = np.array([(k << 64) // self.owners for k in range(first + 1, first + size)], U64)
        cuts = [0, *np.searchsorted(keys, edges, "left").tolist(), len(keys)]
        return {-1 - (first + k): (x, z) for k, (x, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < z}


def route(buckets: int, owners: int, most: int = MOST_BLOBS) -> Route:
    """Direct ways for at most ``most`` blobs, else relays: about the roots of the numbers
    of owners and buckets, so that no sender has more than that many blobs."""
    if buckets * owners <= most:
        return Route(owners, owners, 1)
    size = math.isqrt(owners - 1) + 1
    groups = -(-owners // size)
    # whole groups, so that the edges of groups are edges of owners
    return Route(groups * size, groups, math.isqrt(buckets - 1) + 1)


def exchange(rows: DataFrame, way: Route, own, merge, answer, schema: str) -> DataFrame:
    """Rows (target, source, ...) to the owners, and what these reply to the buckets."""
    if way.direct:
        return rows.groupBy("target").applyInArrow(own, schema)
    sent = rows.groupBy("target")
    back = sent.applyInArrow(merge, schema).groupBy("target").applyInArrow(own, schema)
    return sent.cogroup(back.groupBy("target")).applyInArrow(answer, schema)


def golomb(sorted_values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending distinct 64-bit values.

    The parameter is the power of two below the mean gap; quotients are unary and
    remainders plain bits.  The first value is a gap from zero like all others.
    """
    n = len(sorted_values)
    if not n:
        return b""
    v = sorted_values.astype(U64)
    first, gaps = v[0], np.diff(v)
    mean = int(v[-1] - first) // max(1, n - 1) if n > 1 else 1
    r = max(0, min(56, mean.bit_length() - 1))
    quotient = (gaps >> U64(r)).astype(np.int64)
    # unary parts: a one after each quotient's zeros
    ones = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if n > 1 else 0, np.uint8)
    unary[ones] = 1
    low = ((gaps[:, None] >> np.arange(r, dtype=U64)[None, :]) & U64(1)).astype(np.uint8) if r else np.zeros((n - 1, 0), np.uint8)
    head = np.array([n, r, len(unary)], np.int64).tobytes() + first.tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def ungolomb(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    n, r, width = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    first = np.frombuffer(blob, U64, 1, 24)[0]
    out = np.empty(n, U64)
    out[0] = first
    if n > 1:
        cut = 32 + (width + 7) // 8
        unary = np.unpackbits(np.frombuffer(blob, np.uint8, cut - 32, 32), count=width)
        quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
        gaps = quotient.astype(U64) << U64(r)
        if r:
            low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=cut), count=(n - 1) * r).reshape(n - 1, r)
            gaps |= (low.astype(U64) << np.arange(r, dtype=U64)[None, :]).sum(axis=1, dtype=U64)
        out[1:] = first + np.cumsum(gaps, dtype=U64)
    return out


def pack(array: np.ndarray) -> bytes:
    """A small-integer array, which is mostly one value, as deflated bytes."""
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)
