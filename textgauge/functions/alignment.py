"""Token alignment: edit counts with a fixed tie order, and bounded error rates.

Of equal distances the alignment with the fewest gaps counts.  At one cell of the
table deletions less insertions are the cell's place, so distance and gaps tell all
counts, and a cost is one integer of the two.  A batch's pairs are aligned together:
by anti-diagonals, so that a step is a few array operations, and inside a band around
the main diagonal that is widened until it holds the distance (Ukkonen's bound).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = 1 << 32
_SUBSTITUTE, _GAP, _FAR = _ONE, _ONE + 1, 1 << 60
#: Cells of a band that are held at once, by all pairs aligned together; a pair of more is alone.
CELLS = 1 << 20
#: How far a band reaches beyond the difference of lengths at first, and how it grows.
_REACH, _WIDER = 12, 3

COUNTS = "distance int, substitutions int, deletions int, insertions int"


def _coded_batch(reference: pa.Array, hypothesis: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of both sides as small integers, and how many each list has."""
    sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (reference, hypothesis)]
    values = [a.flatten() for a in (reference, hypothesis)]
    kind = values[0].type if values[0].type != pa.null() else values[1].type
    codes = pa.concat_arrays([v.cast(kind) for v in values]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[: len(values[0])], sizes[0], codes[len(values[0]) :], sizes[1]


def _padded(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, filler: int) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max())), filler, np.int32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.concatenate([codes[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)])
    return out


def _banded(r: np.ndarray, h: np.ndarray, r_size: np.ndarray, h_size: np.ndarray, band: int) -> np.ndarray:
    """Costs of pairs (padded rows, shortest pairs first) within a band.

    ``cost`` has a column for each diagonal j - i; on a step only every second one is
    reckoned, and those between still hold the step before."""
    pairs, total = len(r), r_size + h_size
    done = np.zeros(pairs, np.int64)
    cost = np.full((pairs, 2 * band + 3), _FAR, np.int64)
    middle = band + 1
    cost[:, middle] = 0
    ends = np.searchsorted(total, np.arange(1, int(total[-1]) + 1), "right")
    live = 0
    for t, end in enumerate(ends.tolist(), 1):
        low, high = max(-band, -t, t - 2 * r.shape[1]), min(band, t, 2 * h.shape[1] - t)
        low, high = low + (low - t) % 2, high - (high - t) % 2
        if low == -t:
            cost[live:, middle + low] = t * _GAP
            low += 2
        if high == t:
            cost[live:, middle + high] = t * _GAP
            high -= 2
        if low <= high:
            i, j = (t - high) // 2, (t + low) // 2
            n = (high - low) // 2 + 1
            same = r[live:, i - 1 : i - 1 + n][:, ::-1] == h[live:, j - 1 : j - 1 + n]
            a, z = middle + low, middle + high + 1
            own = cost[live:, a:z:2]
            best = np.minimum(cost[live:, a - 1 : z - 1 : 2], cost[live:, a + 1 : z + 1 : 2])
            best += _GAP
            np.minimum(best, own + _SUBSTITUTE, out=best)
            cost[live:, a:z:2] = np.where(same, own, best)
        if end > live:
            some = np.arange(live, end)
            at = h_size[some] - r_size[some]
            # a pair whose ends lie outside the band needs a wider one
            done[some] = np.where(np.abs(at) <= band, cost[some, middle + np.clip(at, -band, band)], _FAR)
            live = end
    return done


def _costs(r: np.ndarray, r_size: np.ndarray, h: np.ndarray, h_size: np.ndarray) -> np.ndarray:
    longest = np.maximum(r_size, h_size)
    out = longest * _GAP
    r_first, h_first = np.cumsum(r_size) - r_size, np.cumsum(h_size) - h_size
    left = np.flatnonzero((r_size > 0) & (h_size > 0))
    band = np.minimum(longest, np.abs(r_size - h_size) + _REACH)
    while len(left):
        left = left[np.lexsort((r_size[left] + h_size[left], band[left]))]
        again, at = [], 0
        while at < len(left):
            some = left[at:]
            # pairs of like bands and lengths, as many as fit
            reach = np.maximum.accumulate(2 * band[some] + 3 + longest[some])
            fits = (np.arange(1, len(some) + 1) * reach <= CELLS) & (band[some] <= 2 * band[some[0]]) & (r_size[some] + h_size[some] <= 2 * (r_size[some[0]] + h_size[some[0]]) + 16)
            some = some[: max(1, int(np.argmin(fits)) if not fits.all() else len(some))]
            at += len(some)
            some = some[np.argsort(r_size[some] + h_size[some], kind="stable")]
            width = int(band[some].max())
            found = _banded(_padded(r, r_first[some], r_size[some], -1), _padded(h, h_first[some], h_size[some], -2), r_size[some], h_size[some], width)
            out[some] = found
            short = some[(found >> 32 > width) & (width < longest[some])]
            band[short] = np.minimum(longest[short], _WIDER * width)
            again.append(short)
        left = np.concatenate(again)
    return out


def edit_counts_of(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Distance, substitutions, deletions and insertions of pairs of token lists."""
    r, r_size, h, h_size = _coded_batch(reference, hypothesis)
    cost = _costs(r, r_size, h, h_size)
    distance, gaps, longer = cost >> 32, cost & (_ONE - 1), r_size - h_size
    null = pc.or_(pc.is_null(reference), pc.is_null(hypothesis))
    counts = [distance, distance - gaps, (gaps + longer) // 2, (gaps - longer) // 2]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in counts], ["distance", "substitutions", "deletions", "insertions"], mask=pc.cast(null, pa.bool_()))


def edit_counts(reference: list | None, hypothesis: list | None) -> tuple[int, int, int, int] | None:
    """Distance, substitutions, deletions and insertions from reference to
    hypothesis.  Equal tokens always align; of equal distances the one with the
    fewest gaps counts.  Null in, null out."""
    got = edit_counts_of(*(pa.array([x], pa.list_(pa.string())) for x in (reference, hypothesis)))[0].as_py()
    return got and tuple(got.values())


def edit_counts_udf(reference: Column | str, hypothesis: Column | str) -> Column:
    return F.arrow_udf(edit_counts_of, returnType=f"struct<{COUNTS.replace(' int', ':int')}>")(reference, hypothesis)


#: Tokens that both sides may share: characters beyond the basic plane, less two.
SHARED = 0x10FFFF - 0x10001


def _coded(tokens: Column, shared: Column, codes: Column, other: str) -> Column:
    found = F.transform(tokens, lambda t: F.get(codes, F.array_position(shared, t).cast("int") - 1))
    return F.decode(F.unhex(F.array_join(found, "", other)), "UTF-32")


def coded_pair(df: DataFrame, reference: str, hypothesis: str, into: tuple[str, str]) -> DataFrame:
    """Add two token arrays as strings of one character for each token.

    Tokens of one side only match nothing, so all of a side's have one character,
    and only shared ones need their own.  More than ``SHARED`` of those, in texts
    whose alignment would take days, are an error; ``edit_counts`` has no such limit.
    """
    shared = F.array_intersect(reference, hypothesis)
    few = F.when(F.size(shared) <= SHARED, shared).when(F.size(shared) > SHARED, F.raise_error(F.lit("too many shared tokens for a coded distance; count edits instead")))
    out = df.withColumn("__shared", few)
    out = out.withColumn("__codes", F.transform("__shared", lambda _, i: F.lpad(F.hex(i + F.lit(0x10002)), 8, "0")))
    r, h = (_coded(F.col(c), F.col("__shared"), F.col("__codes"), other) for c, other in ((reference, "00010000"), (hypothesis, "00010001")))
    return out.withColumns({into[0]: r, into[1]: h}).drop("__shared", "__codes")


def token_distance(df: DataFrame, reference: str, hypothesis: str, into: str = "distance") -> DataFrame:
    """Add the edit distance alone, on the JVM: tokens become characters of the built-in."""
    out = coded_pair(df, reference, hypothesis, ("__r", "__h"))
    return out.withColumn(into, F.levenshtein("__r", "__h")).drop("__r", "__h")


def capped(reference: Column, hypothesis: Column, extra: int | Column) -> Column:
    """The first tokens of the hypothesis, ``extra`` more than the reference has."""
    if not isinstance(extra, Column) and (isinstance(extra, bool) or not isinstance(extra, int) or extra < 0):
        raise ValueError("extra tokens: a non-negative integer")
    return F.slice(hypothesis, F.lit(1), F.size(reference) + (extra if isinstance(extra, Column) else F.lit(extra)))


def bounded(distance: Column, size: Column) -> Column:
    """Error rate, one at most; null where the reference is empty."""
    return F.when(size > 0, F.least(F.lit(1.0), distance.cast("double") / size.cast("double")))
