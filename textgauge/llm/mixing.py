"""Mixing sources to target weights with soft domain membership.

A classifier learned from labelled rows gives every document a posterior over
domains.  A document's rate is how often it is to be seen; rates are fitted by
projected-gradient least squares, so that the expected token totals of the domains,
sums of rate x tokens x posterior, meet their targets, every domain's error being a
share of its target.

A step is implicit: it goes against the gradient where it ends, and is projected onto
rates of at least the floor,

    rate = max(floor, first - posterior . move),   move = gradient by domain / pull,

so the rates of all documents follow from one number for each domain, and a pass over
(tokens, posterior) rows tells the totals, the potential and its curvature in the
domains for several moves at once.  The move is found by damped Newton steps on these
sums, the pull is lessened tenfold until the targets are met, and the duality gap of
the least-squares problem proves it where they can't be.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import byte_set, draw_distinct, keyed, materialize, pieces, texts, word_runs

#: Bounds of the labelled sample: documents of each domain, and the bytes beyond which an
#: excerpt of as many characters stands for a document.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 16384
CELLS = 8192
#: Largest error of a domain at which the fit ends, and up to which its targets count as met.
CLOSE, WITHIN = 1e-4, 0.005
#: Gap between the objective and its lower bound, as a share of it, at which the best fit is found.
GAP = 1e-3
#: Newton steps tried in one pass, as shares of the whole one; pulls tried, and the first passes'.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)
LEAST_PULL, SPRINT = 1e-13, 8
_INSIDE = ~byte_set(space=(32, 32), controls=(9, 13))
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def _cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed letter triples, a row for each document."""
    n = len(offsets) - 1
    out = np.zeros((n, CELLS), np.float32)
    if len(data) >= 3:
        f = _FOLD[data]
        code = ((f[:-2] * np.uint32(0x9E3779B1) ^ f[1:-1] * np.uint32(0x85EBCA77) ^ f[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (CELLS - 1).bit_length())
        for d in range(n):
            a, z = offsets[d], offsets[d + 1] - 2
            if z > a:
                out[d] = np.bincount(code[a:z], minlength=CELLS)
    return out


@dataclass(frozen=True)
class Domains:
    """Log odds of letter triples by domain, and how sharply they decide."""

    names: list[str]
    table: np.ndarray
    prior: np.ndarray
    sharpness: float

    def posterior(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        c = _cells(data, offsets)
        n = c.sum(axis=1)
        mean = (c @ self.table) / np.maximum(n, 1)[:, None]
        # evidence grows with a text's length but slowly, so that membership stays soft
        z = self.sharpness * np.sqrt(n)[:, None] * mean + self.prior
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def learn_domains(labelled: DataFrame) -> Domains:
    """Train on a bounded sample of rows with a non-null ``domain``, drawn by a hash
    of their texts: of every domain about ``SAMPLE_DOCS`` different texts, of long
    ones an excerpt.  Null domains and texts under three bytes teach nothing; repeated
    rows count for the domains' shares only."""
    usable = labelled.where(F.col("domain").isNotNull() & (F.octet_length("text") > 2))
    counts, drawn = draw_distinct(usable, "domain", 31, SAMPLE_DOCS, SAMPLE_BYTES)
    names = sorted(counts)
    if not names:
        return Domains(["all"], np.zeros((CELLS, 1)), np.zeros(1), 1.0)
    rows = drawn.orderBy("domain", F.xxhash64("text"), "text").select("domain", "text").collect()
    data, offsets = texts(pa.array([r.text for r in rows], pa.large_string()))
    number = {k: i for i, k in enumerate(names)}
    y = np.array([number[r.domain] for r in rows], int)

    def cells():
        # a piece at a time, as the counts of many domains are large
        for i, j in pieces(offsets):
            yield slice(i, j), _cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    total = np.full((len(names), CELLS), 0.5)
    for at, c in cells():
        np.add.at(total, y[at], c)
    total = total.T
    table = np.log(total / total.sum(axis=0))
    table -= table.mean(axis=1, keepdims=True)
    prior = np.log([counts[k] / sum(counts.values()) for k in names])
    # sharpness: best held-in likelihood on a grid
    z = np.zeros((len(rows), len(names)))
    for at, c in cells():
        n = np.maximum(c.sum(axis=1), 1)
        z[at] = np.sqrt(n)[:, None] * (c @ table) / n[:, None]
    best = max((0.5 * 2**k for k in range(12)), key=lambda s: _likelihood(s * z + prior, y))
    return Domains(names, table, prior, float(best))


def _likelihood(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).sum())


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, floor: float = 0.0, smoothing: float = 0.7) -> DataFrame:
    """Fit a rate for every document: doc_id, n_tokens, posterior, rate, error, reached.

    ``labelled`` has ``text`` and ``domain``.  ``weights`` gives domains their
    shares of all tokens; by default a domain's share is its present share to the
    power ``smoothing``, scaled to one.  With ``floor`` 0 the token total stays;
    with a floor above 0 it grows as far as the targets need.  Of rates that meet the
    targets those nearest to one are taken.  Targets that no rates meet are
    approached as far as least squares go: ``error`` is the largest error of a domain as a
    share of its target, ``reached`` whether it is at most ``WITHIN`` (both the same in
    every row).  Null and empty texts have no tokens, the prior as posterior, and a rate
    like any other.  With nothing labelled there is one domain, and all rates are one.
    Repeated rows get equal rates; the order and number of columns do not matter.  The
    domains, in the order of ``posterior``, are in that column's metadata.
    """
    return fit_rates(membership(docs, labelled), weights, floor, smoothing)


def _posteriors(model: Domains, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = [np.zeros((0, len(model.names)))]
    for i, j in pieces(offsets):
        for k in range(i, j, 256):
            some = offsets[k : min(j, k + 256) + 1]
            out.append(model.posterior(data[some[0] : some[-1]], some - some[0]))
    return np.concatenate(out)


def membership(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Tokens and domain posteriors: doc_id, n_tokens, posterior."""
    model = learn_domains(keyed(labelled, "text", "domain"))
    return _membership(docs, docs.sparkSession.sparkContext.broadcast(model), model.names)


def named(members: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the names of their posterior's domains in that column's metadata."""
    return members.withColumn("posterior", F.col("posterior").alias("posterior", metadata={"domains": names}))


def domains(members: DataFrame) -> list[str]:
    return list(members.schema["posterior"].metadata["domains"])


def _membership(docs: DataFrame, sent, names: list[str]) -> DataFrame:
    def run(batches):
        model = sent.value
        for b in batches:
            data, offsets = texts(b.column(1))
            n = [np.diff(word_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _INSIDE)[2]) for i, j in pieces(offsets)]
            width, rows = len(model.names), len(b.column(0))
            post = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(_posteriors(model, data, offsets).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), post], ["doc_id", "n_tokens", "posterior"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return named(materialize(spread_rows(keyed(docs, "doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, posterior array<double>")), names)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """The move that leads to the rates, the least rate, the largest error of a domain as
    a share of its target, the duality gap as a share of the objective (0 where the
    targets are met), and the passes taken."""

    move: np.ndarray
    floor: float
    error: float = 0.0
    gap: float = 0.0
    passes: int = 0

    @property
    def reached(self) -> bool:
        return self.error <= WITHIN

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        first = max(1.0, self.floor)
        return np.maximum(self.floor, first - posterior @ self.move) if len(self.move) else np.full(len(posterior), first)


@dataclass(frozen=True)
class _Sums:
    """What a pass tells of one move: totals by domain, their curvature, and the potential."""

    totals: np.ndarray
    curvature: np.ndarray
    potential: float


class _Passes:
    """Passes over rows of (n_tokens, posterior) for a fit with this floor."""

    def __init__(self, members: DataFrame, width: int, floor: float):
        self.rows, self.width, self.floor, self.taken = members.select("n_tokens", "posterior"), width, floor, 0

    def at(self, moves: list[np.ndarray]) -> list[_Sums]:
        """Sums for several moves in one pass."""
        self.taken += 1
        width, floor, first = self.width, self.floor, max(1.0, self.floor)
        stacked = np.array(moves)

        def run(batches):
            out = np.zeros((len(stacked), width + width * width + 1))
            for b in batches:
                t, every = b.column(0).to_numpy(zero_copy_only=False).astype(float), _matrix(b.column(1), width)
                for i in range(0, len(t), 1 << 15):
                    n, p = t[i : i + (1 << 15)], every[i : i + (1 << 15)]
                    for k, move in enumerate(stacked):
                        z = first - p @ move
                        free = z > floor
                        out[k, :width] += (n * np.maximum(z, floor)) @ p
                        out[k, width:-1] += ((p * (n * free)[:, None]).T @ p).ravel()
                        out[k, -1] += n @ np.where(free, 0.5 * z * z, floor * z - 0.5 * floor * floor)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(out.size), pa.int32()), "v": pa.array(out.ravel())})

        got = {r.k: r.v for r in self.rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        all_ = np.array([got.get(k, 0.0) for k in range(len(moves) * (width + width * width + 1))]).reshape(len(moves), -1)
        return [_Sums(x[:width], x[width:-1].reshape(width, width), float(x[-1])) for x in all_]

    def least(self, slope: np.ndarray) -> float:
        """The least product of a row's posterior with ``slope``."""
        self.taken += 1
        width = self.width

        def run(batches):
            least = [float((_matrix(b.column(0), width) @ slope).min()) for b in batches if len(b)]
            yield pa.RecordBatch.from_pydict({"v": pa.array([min(least)] if least else [], pa.float64())})

        return float(self.rows.where("n_tokens > 0").select("posterior").mapInArrow(run, "v double").agg(F.min("v")).first()[0] or 0.0)


def solve(members: DataFrame, weights: dict[str, float] | None, floor: float, smoothing: float) -> Fit:
    """The least-squares fit of ``mixing_rates`` for rows of ``membership``."""
    names = domains(members)
    width, none = len(names), np.zeros(0)
    if weights and names != ["all"] and (unknown := sorted(set(weights) - set(names))):
        raise ValueError(f"weights of domains without labelled text: {unknown}")
    passes, still = _Passes(members, width, floor), np.zeros(width)
    start = passes.at([still])[0]
    whole = float(start.totals.sum())
    if whole <= 0 or names == ["all"]:
        return Fit(none, floor)
    # totals are shares of all tokens at the first rate
    now = start.totals / whole
    share = np.array([weights.get(k, 0.0) for k in names]) if weights else np.power(now, smoothing)
    share = share / share.sum() if share.sum() > 0 else now
    target = share * (1.0 if floor <= 0 else max(1.0, float(np.max(now / np.where(share > 0, share, np.inf)))))
    relative = np.maximum(np.where(target > 0, target, now), 1e-12)
    weight = relative**2

    def missed(s: _Sums) -> np.ndarray:
        return s.totals / whole - target

    def error(s: _Sums) -> float:
        return float(np.abs(missed(s) / relative).max())

    def potential(move: np.ndarray, s: _Sums, pull: float) -> float:
        return s.potential / whole + target @ move + 0.5 * pull * (weight * move) @ move

    def newton(move: np.ndarray, s: _Sums, pull: float, most: int) -> tuple[np.ndarray, _Sums]:
        """The move at which the step of this pull ends."""
        for _ in range(most):
            slope = pull * weight * move - missed(s)
            if np.abs(slope / relative).max() <= max(CLOSE / 5, 0.02 * error(s)):
                break
            step = -np.linalg.lstsq(s.curvature / whole + np.diag(pull * weight), slope, rcond=1e-15)[0]
            tried = [move + a * step for a in STEPS]
            found = passes.at(tried)
            best = int(np.argmin([potential(m, x, pull) for m, x in zip(tried, found, strict=True)]))
            move, s = tried[best], found[best]
        return move, s

    if error(start) <= CLOSE:
        return Fit(still, floor, error(start), 0.0, passes.taken)
    # targets within easy reach take a few steps at a small pull
    move, s = newton(still, start, 1e-6, SPRINT)
    if error(s) <= CLOSE:
        return Fit(move, floor, error(s), 0.0, passes.taken)
    move, s, pull = still, start, 1.0
    while True:
        move, s = newton(move, s, pull, 60)
        # the gap to the dual value of the errors, made feasible by adding the same to all domains
        y = missed(s) / weight
        reached = 0.5 * float((missed(s) / relative) @ (missed(s) / relative))
        y = y + max(0.0, -passes.least(y))
        bound = floor * float(now @ y) / max(1.0, floor) - float(target @ y) - 0.5 * float((weight * y) @ y)
        gap = (reached - bound) / max(reached, 1e-300)
        if error(s) <= CLOSE or gap <= GAP or pull < LEAST_PULL:
            return Fit(move, floor, error(s), 0.0 if error(s) <= CLOSE else gap, passes.taken)
        pull /= 10
        # out of reach the move grows as the pull falls
        tried = [move, 3 * move, 10 * move]
        found = passes.at(tried)
        best = int(np.argmin([potential(m, x, pull) for m, x in zip(tried, found, strict=True)]))
        move, s = tried[best], found[best]


def fit_rates(members: DataFrame, weights: dict[str, float] | None, floor: float, smoothing: float) -> DataFrame:
    """Rows of ``membership`` with their fitted rates, and how well these meet the targets."""
    fit, names = solve(members, weights, floor, smoothing), domains(members)

    def run(batches):
        for b in batches:
            yield b.append_column("rate", pa.array(fit.rates(_matrix(b.column("posterior"), len(names)))))

    rated = members.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in members.dtypes)}, rate double")
    return named(rated, names).withColumns({"error": F.lit(fit.error), "reached": F.lit(fit.reached)})


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, floor: float = 1.0, smoothing: float = 0.7) -> DataFrame:
    """The documents in their mixture: each row as often as its rate says, a
    fraction being decided by a hash of its id and text.  Columns stay; with a
    floor of one or more every row is there at least once.  Null and empty texts
    have the rate of the prior; rows that repeat are repeated alike; an empty table
    stays empty, and with nothing labelled all rows stay once.  Targets that no rates
    meet are approached as ``mixing_rates`` does, with a warning."""
    learned = learn_domains(keyed(labelled, "text", "domain"))
    model = docs.sparkSession.sparkContext.broadcast(learned)
    fit = solve(_membership(docs, model, learned.names), weights, floor, smoothing)
    if not fit.reached:
        warnings.warn(f"no rates meet the targets; the largest error is {fit.error:.3g} of a target", stacklevel=2)
    at, key = docs.schema.names.index("text"), docs.schema.names.index("doc_id")

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            data, offsets = texts(b.column(at))
            rate = fit.rates(_posteriors(model.value, data, offsets))
            draws = [xxhash.xxh3_64_intdigest(f"{i}|".encode() + data[x:z].tobytes()) / 2**64 for i, x, z in zip(b.column(key).to_pylist(), offsets[:-1], offsets[1:], strict=True)]
            times = np.floor(rate + np.array(draws)).astype(np.int64)
            yield b.take(pa.array(np.repeat(np.arange(len(b)), times)))

    return docs.mapInArrow(run, docs.schema)
