"""Toxicity by a weighted finite-state pattern grammar.

A transducer over words puts out symbols (insult, threat, target, negation, report,
boundary, other): insults and threats are patterns of one or several words, with other
words between them, and put out where a pattern ends.
Small transducers read these symbols and mark insults and threats: one marks those
beside a target, one those beside a negation, one those in reported speech or under
discussion as words.  Each exists for cues before and for cues after the marked word;
the three of a direction are composed into one machine, and a sentence is read by the
machine for cues after, from its end, and by the other from its beginning.  A last
transducer weighs what was marked: a threat without a target or with a negation is
no match, and every mark has its factor.  A clause's score is the sum of its matches' weights.

Learned from labels are the insult stems with their weights, so that any language's
words can be among them, the factors of the marks, and the coefficients that turn a
document's clause scores into a probability.  A word alone in a clause is the frame
``bare``, whose factor is learned like the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import keyed, materialize, partitions

#: Bounds of the labelled sample: documents of each label, and the bytes beyond which an
#: excerpt of as many characters stands for a document.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 18
#: Share of the toxic documents from which on a stem is common.
COMMON = 0.01
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY = range(SYMBOLS := 7)
#: Marks of insults and threats; a marked symbol is its symbol plus ``SYMBOLS`` times the marks' sum.
AIMED, NEGATED, REPORTED = 1, 2, 4
MARKS = 8
#: The marks' cues, how many symbols they reach onward and back, and whether a clause's end stops them.
CUES = {AIMED: (TARGET, 3, 3, True), NEGATED: (NEGATION, 3, 1, True), REPORTED: (REPORT, 8, 4, False)}
#: Factors where the labels do not tell: of an insult without and with a target, of a threat, of negation and report.
FACTORS = {"bare": 0.5, "aimed": 1.0, "threat": 1.5, "negated": 0.3, "reported": 0.4}
_WORDS = {
    INSULT: "idiot idiots moron morons scum loser losers worthless pathetic stupid disgusting vermin imbecile idiota idiotas estúpido imbécile abruti dummkopf abschaum",
    THREAT: "kill murder strangle slaughter behead töten umbringen ermorden tuer assassiner égorger matar asesinar degollar",
    TARGET: "you your yours he she it they him her them his their this that these those du dich dir ihr euch sie er es tu toi vous il elle eux lui tú usted ellos ella ese esa lo",
    NEGATION: "not never no isn't aren't wasn't don't nobody nicht nie kein keine niemals pas jamais ni nunca jamás tampoco",
    REPORT: "said says claimed claims wrote reported quoted alleged word words term means meaning sagte sagt behauptete schrieb wort begriff bedeutet dit disait affirmait écrivait mot terme signifie dijo dice afirmó escribió palabra término significa",
}
_FIXED = {w: k for k, words in _WORDS.items() for w in words.split()}
#: Patterns of several words: alternatives of a step are parted by bars, ``*`` ends a beginning.
PHRASES = {
    INSULT: [
        "piece|load|pile of garbage|trash|dirt|filth", "waste|wastes of space|oxygen|breath|skin", "good for nothing", "no one likes you|your", "shut up|your", "brain dead", "dumb as rock*|dirt",
        "stück dreck|scheiße", "halt die|deine klappe|fresse|schnauze", "pedazo de basura|mierda", "cierra|cállate la|tu boca", "bon|bonne à rien", "tas de merde|ordures", "ferme ta gueule|bouche",
    ],
    THREAT: [
        "will|gonna|going|shall|must hurt*|harm*|hunt*|destroy*|burn*|shoot*|stab*|beat*|crush*", "watch your back", "deserve* to die|burn|suffer", "you are|were dead", "end your life", "make you suffer|pay|bleed",
        "werde|werden dich|euch|sie finden|kriegen|vernichten", "vais|allons te|vous crever|frapper|détruire", "voy|vamos a|te romper*|golpear*|destruir*",
    ],
}
#: Other words that may stand between two steps of a pattern, in one clause.
BETWEEN = 2
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_TOKEN_OR_COMMA = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|,")
_SENTENCE = re.compile(r"[.;:?!\n\r|]+")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over marked symbols.

    ``arcs[state][symbol]`` is (next state, symbol put out, log factor)."""

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]

    def compose(self, other: Transducer) -> Transducer:
        """First this machine, then ``other`` on what it puts out."""
        number, queue, out = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = []
            for symbol in range(SYMBOLS * MARKS):
                a2, middle, w = self.arcs[a][symbol]
                b2, final, v = other.arcs[b][middle]
                if (a2, b2) not in number:
                    number[a2, b2] = len(queue)
                    queue.append((a2, b2))
                row.append((number[a2, b2], final, w + v))
            out.append(tuple(row))
        return Transducer(tuple(out))

    def read(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """Symbols put out and log factors."""
        state, out, factors = 0, [], []
        for s in symbols:
            state, s, f = self.arcs[state][s]
            out.append(s)
            factors.append(f)
        return out, factors


def marker(mark: int, cue: int, reach: int, stops: bool) -> Transducer:
    """Marks insults and threats up to ``reach`` symbols after a cue; states are the
    symbols still within reach.  Where it ``stops``, a boundary ends the reach; else
    boundaries are not counted."""
    rows = []
    for left in range(reach + 1):
        row = []
        for s in range(SYMBOLS * MARKS):
            kind = s % SYMBOLS
            if kind == cue:
                following = reach
            elif kind == BOUNDARY:
                following = 0 if stops else left
            else:
                following = max(0, left - 1)
            hit = left > 0 and kind in (INSULT, THREAT) and not s // SYMBOLS & mark
            row.append((following, s + SYMBOLS * mark if hit else s, 0.0))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def _direction(back: bool) -> Transducer:
    machine = None
    for mark, (cue, onward, behind, stops) in CUES.items():
        one = marker(mark, cue, behind if back else onward, stops)
        machine = one if machine is None else machine.compose(one)
    return machine


#: Cues before a word, read from the beginning; cues after it, read from the end.
ONWARD, BACK = _direction(False), _direction(True)


def factor(symbol: int, factors: dict[str, float]) -> float:
    """What a marked symbol's weight is multiplied by; zero where it is no match."""
    kind, marks = symbol % SYMBOLS, symbol // SYMBOLS
    if kind not in (INSULT, THREAT) or (kind == THREAT and (not marks & AIMED or marks & NEGATED)):
        return 0.0
    out = factors["threat"] if kind == THREAT else factors["aimed" if marks & AIMED else "bare"]
    return out * (factors["negated"] if marks & NEGATED else 1.0) * (factors["reported"] if marks & REPORTED else 1.0)


def weigher(factors: dict[str, float]) -> Transducer:
    """Puts out matches with their log factors and all else as other."""
    row = []
    for s in range(SYMBOLS * MARKS):
        f = factor(s, factors)
        row.append((0, s if f or s % SYMBOLS == BOUNDARY else OTHER, math.log(f) if f else 0.0))
    return Transducer((tuple(row),))


class Patterns:
    """The transducer over words: reads a clause's words and puts out insults and threats
    where their patterns end.

    A state is the set of begun patterns with the step they wait for and the words let
    pass since; states are numbered as they are met, and a boundary is back to the first."""

    def __init__(self, phrases: dict[int, list[str]] = PHRASES, between: int = BETWEEN):
        self.between, self.patterns = between, [(kind, [step.split("|") for step in p.split()]) for kind, all_ in phrases.items() for p in all_]
        #: Steps that a word, or a word with this beginning, can be.
        self.whole: dict[str, set] = {}
        self.begun: dict[str, set] = {}
        for k, (_, steps) in enumerate(self.patterns):
            for n, words in enumerate(steps):
                for w in words:
                    (self.begun if w.endswith("*") else self.whole).setdefault(w.rstrip("*"), set()).add((k, n))
        self.steps = lru_cache(maxsize=1 << 16)(self._steps)
        self.arcs: dict[tuple[frozenset, frozenset], tuple[frozenset, int]] = {}

    def _steps(self, word: str) -> frozenset:
        found = set(self.whole.get(word, ()))
        for n in range(1, len(word) + 1):
            found |= self.begun.get(word[:n], set())
        return frozenset(found)

    def anchors(self) -> list[str]:
        """What a sentence holds wherever a pattern is in it: the words of the step whose
        shortest word is longest, of each pattern."""
        steps = (max(steps, key=lambda words: min(len(w.rstrip("*")) for w in words)) for _, steps in self.patterns)
        return sorted({w.rstrip("*") for words in steps for w in words})

    def _arc(self, state: frozenset, steps: frozenset) -> tuple[frozenset, int]:
        following, out = set(), OTHER
        for k, n, passed in [*state, *((k, 0, 0) for k, n in steps if n == 0)]:
            if (k, n) in steps:
                if n + 1 == len(self.patterns[k][1]):
                    out = max(out, self.patterns[k][0])
                else:
                    following.add((k, n + 1, 0))
            if n and passed < self.between:
                following.add((k, n, passed + 1))
        return frozenset(following), out

    def read(self, words: list[str]) -> list[int]:
        """An insult or threat for every word that ends a pattern, else other."""
        state, out = frozenset(), []
        for w in words:
            if w == ",":
                state, kind = frozenset(), OTHER
            else:
                arc = state, self.steps(w)
                if arc not in self.arcs:
                    self.arcs[arc] = self._arc(*arc)
                state, kind = self.arcs[arc]
            out.append(kind)
        return out


class Lexicon:
    """Symbols and weights of words; insult stems end in ``$`` where they are whole words."""

    def __init__(self, stems: dict[str, float], factors: dict[str, float] | None = None):
        self.stems = dict(stems)
        self.grammar = ONWARD.compose(weigher(FACTORS if factors is None else factors))
        self.find = ahocorasick.Automaton()
        for stem in self.stems:
            self.find.add_word(stem.rstrip("$"), True)
        for w, k in _FIXED.items():
            if k in (INSULT, THREAT):
                self.find.add_word(w, True)
        self.patterns = Patterns()
        for w in self.patterns.anchors():
            self.find.add_word(w, True)
        self.find.make_automaton()
        self.longest = max((len(s) for s in self.stems), default=0)
        self.symbol = lru_cache(maxsize=1 << 16)(self._symbol)

    def _symbol(self, word: str) -> tuple[int, float]:
        if word == ",":
            return BOUNDARY, 0.0
        best = self.stems.get(word + "$", 0.0)
        for k in range(2, min(len(word), self.longest) + 1):
            best = max(best, self.stems.get(word[:k], 0.0))
        if best:
            return INSULT, best
        kind = _FIXED.get(word, OTHER)
        return kind, 2.0 if kind in (INSULT, THREAT) else 0.0

    def sentences(self, text: str | None):
        """(symbols marked by the cues after them, weights) of sentences that hold an insult or threat."""
        low = text.lower() if text else ""
        # an anchor may stand before its pattern's end, but in the same sentence
        places = [end for end, _ in self.find.iter(low)] if low else []
        if not places:
            return
        at, k = 0, 0
        for a, z in [*(m.span() for m in _SENTENCE.finditer(low)), (len(low), len(low))]:
            hit = False
            while k < len(places) and places[k] < z:
                hit = hit or places[k] >= at
                k += 1
            if hit:
                words = _TOKEN_OR_COMMA.findall(low[at:a])
                # a pattern's end weighs as much as a fixed word; a word that is one already stays so
                pairs = [p if p[1] or not kind else (kind, 2.0) for p, kind in zip(map(self.symbol, words), self.patterns.read(words), strict=True)]
                if any(w for _, w in pairs):
                    yield BACK.read([p for p, _ in reversed(pairs)])[0][::-1], [w for _, w in pairs]
            at = z

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that the grammar matches."""
        out = []
        for symbols, weights in self.sentences(text):
            total = 0.0
            for s, f, w in zip(*self.grammar.read(symbols), weights, strict=True):
                if s == BOUNDARY:
                    out.append(total)
                    total = 0.0
                elif s:
                    total += w * math.exp(f)
            out.append(total)
        return [x for x in out if x > 0]

    def frames(self, text: str | None) -> np.ndarray:
        """Summed weights of insults and threats by their marks."""
        out = np.zeros(SYMBOLS * MARKS)
        for symbols, weights in self.sentences(text):
            for s, w in zip(ONWARD.read(symbols)[0], weights, strict=True):
                out[s] += w
        return out


def features(total: float, length: int) -> list[float]:
    """What a document's clause scores say: their sum, their sum by length, whether there are any."""
    return [1.0, math.log1p(total), math.log1p(1000 * total / (200 + length)), float(total > 0)]


def _stems_of(text: str) -> set[str]:
    seen = set()
    for w in set(_TOKEN.findall(text.lower())):
        seen.add(w + "$")
        seen.update(w[:k] for k in range(3, min(9, len(w) + 1)))
    return seen


def _partial_counts(batches):
    """Documents by stem, half and label of a partition: clean and toxic of half 0, then of half 1."""
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for stem in _stems_of(text):
                counts.setdefault(stem, [0, 0, 0, 0])[2 * half + toxic] += 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([v[k] for v in counts.values()], pa.int64()) for k in range(4))], ["stem", "c0", "t0", "c1", "t1"])


def learn_stems(counts: tuple[Counter, Counter], n: list[int]) -> dict[str, float]:
    """Word beginnings, and whole words (with ``$``), that toxic documents have and
    clean ones hardly do, with log odds as weights.

    A stem counts where one in a hundred toxic documents has it, or where its likelihood
    ratio is beyond what the best of all stems would have by chance, however few
    documents hold it.  Of beginnings that stand for about the same documents the
    longest is kept, and a stem that a shorter one covers with about its weight is left out."""
    (clean, toxic), (c, t) = counts, n
    beyond = 2 * math.log(max(2, len(toxic))) + 4
    odds = {}
    for stem, a in toxic.items():
        b = clean[stem]
        if a < 3 or a * c <= b * t:
            continue
        w = math.log((a + 0.5) / (t + 1)) - math.log((b + 0.5) / (c + 1))
        ratio = 2 * (a * math.log(a * (t + c) / ((a + b) * t)) + (b * math.log(b * (t + c) / ((a + b) * c)) if b else 0.0))
        if w >= 2.5 and (a >= COMMON * t or ratio > beyond):
            odds[stem] = w
    # the most toxic documents of any longer stem with this beginning
    longer: dict[str, int] = {}
    for x in odds:
        for k in range(3, len(x)):
            longer[x[:k]] = max(longer.get(x[:k], 0), toxic[x])
    twin = {x for x in odds if longer.get(x, 0) >= 0.95 * toxic[x]}
    stems = {}
    for stem, w in odds.items():
        if stem in twin and not stem.endswith("$"):
            continue
        shorter = (stem[:k] for k in range(3, len(stem.rstrip("$")) + 1) if stem[:k] != stem)
        if not any(x in odds and x not in twin and odds[x] >= w - 0.7 and toxic[x] > toxic[stem] for x in shorter):
            stems[stem] = w
    return dict(sorted(stems.items()))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _factor_row(factors: dict[str, float]) -> np.ndarray:
    return np.array([factor(s, factors) for s in range(SYMBOLS * MARKS)])


def _likelihood(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w, -30, 30)
    return float((weight * (y * z - np.log1p(np.exp(z)))).sum() - 0.05 * w @ w)


def learn_factors(frames: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Factors of the marks and coefficients of the documents' features, together of
    the greatest likelihood on a grid around the factors as they are.

    A factor on which the sample's documents hardly depend stays as it is."""
    factors = dict(FACTORS)

    def design(now):
        total = frames @ _factor_row(now)
        return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / (200 + lengths)), (total > 0).astype(float)])

    def rate(now):
        x = design(now)
        w = fit(x, y, weight)
        return _likelihood(x, y, weight, w), w

    best, w = rate(factors)
    for name in ("bare", "negated", "reported", "threat"):  # the factor of an aimed insult is the unit
        off = _factor_row({**factors, name: 0.0})
        if (frames @ np.abs(_factor_row(factors) - off) > 0).sum() < 20:
            continue
        for value in (0.05, 0.1, 0.2, 0.5, 0.8, 1.0, 1.5, 2.0):
            there, v = rate({**factors, name: value})
            if there > best + 2:
                best, w, factors = there, v, {**factors, name: value}
    return factors, w


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    factors: dict[str, float]
    coefficients: list[float]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from at most about ``sample_docs`` documents of each label, drawn by a
    hash of their ids, of texts beyond ``SAMPLE_BYTES`` an excerpt from a place that their hash tells.

    Stems are counted and clauses read on the executors; the driver holds counts of
    stems that three toxic documents have, and a row of frames for each document.
    Labels other than 0 and 1 and null ids count as none.  Texts that repeat under
    one label count once, null and empty texts teach nothing.  Where one label has
    no document, the fixed words and factors alone are the model."""
    spark = docs.sparkSession
    known = keyed(labels, "doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_docs / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, sample_docs / max(1, n.get(0, 0)))))
    # about 2 * sample_docs rows of two integers, whatever the labels' number
    drawn = known.where(draw < share * float(1 << 40))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - F.lit(SAMPLE_BYTES - 1))).cast("int") + 1
    part = F.when(F.octet_length("text") > SAMPLE_BYTES, F.substring("text", start, F.lit(SAMPLE_BYTES))).otherwise(F.col("text"))
    own = keyed(docs, "doc_id", "text").where("text <> ''").select("doc_id", part.alias("text"))
    rows = own.join(F.broadcast(drawn), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    # copies of one text would make its chance words look common; dealt by number, as they cost far more than their bytes
    rows = materialize(rows.repartition(partitions(spark), "text", "toxic").distinct().withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))
    seen = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    size = [[seen.get((h, k), 0) for k in (0, 1)] for h in (0, 1)]
    if not all(size[0][k] + size[1][k] for k in (0, 1)):
        return Model({}, dict(FACTORS), [-3.0, 1.5, 1.0, 1.0])
    counted = rows.mapInArrow(_partial_counts, "stem string, c0 bigint, t0 bigint, c1 bigint, t1 bigint").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]).where("t0 + t1 >= 3").collect()
    halves = [(Counter({r.stem: r[f"c{h}"] for r in counted}), Counter({r.stem: r[f"t{h}"] for r in counted if r[f"t{h}"]})) for h in (0, 1)]
    # stems from one half weigh the other half's documents, so that chance stems are priced
    sent = spark.sparkContext.broadcast([learn_stems(halves[1 - h], size[1 - h]) for h in (0, 1)])

    def read(batches):
        other = [Lexicon(stems) for stems in sent.value]
        for b in batches:
            texts, toxic, half = (c.to_pylist() for c in b.columns)
            found = [other[h].frames(t).tolist() for t, h in zip(texts, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array([len(t) for t in texts], pa.int64()), b.column(1)], ["frames", "length", "toxic"])

    found = rows.mapInArrow(read, "frames array<double>, length bigint, toxic int").toArrow().sort_by([("toxic", "ascending"), ("length", "ascending")])
    frames = np.array(found["frames"].to_pylist()).reshape(-1, SYMBOLS * MARKS)
    lengths, y = found["length"].to_numpy().astype(float), found["toxic"].to_numpy().astype(float)
    total = n[0] + n[1]
    weight = np.where(y > 0, n[1] / total * len(y) / max(1.0, y.sum()), n[0] / total * len(y) / max(1.0, len(y) - y.sum()))
    factors, w = learn_factors(frames, lengths, y, weight)
    both = tuple(halves[0][k] + halves[1][k] for k in (0, 1))
    return Model(learn_stems(both, [size[0][k] + size[1][k] for k in (0, 1)]), factors, w.tolist())


class Scorer:
    """A model as a function from texts to scores and matched clauses."""

    def __init__(self, model: Model):
        self.lexicon, self.weights = Lexicon(model.stems, model.factors), model.coefficients

    def __call__(self, text: str | None) -> tuple[float, int]:
        found = self.lexicon.clauses(text)
        x = features(sum(found), len(text or ""))
        z = max(-30.0, min(30.0, sum(a * b for a, b in zip(x, self.weights, strict=True))))
        return 1 / (1 + math.exp(-z)), len(found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every text: doc_id, score (0 to 1), predicted (1 from 0.5), clauses
    (how many the grammar matches).  Null and empty texts match no clause and get
    the score of such a text.  Repeated rows are scored alike; an empty table gives
    none; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Scorer(sent.value)
        for b in batches:
            judged = [judge(t) for t in b.column(1).to_pylist()]
            scores = [s for s, _ in judged]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([n for _, n in judged], pa.int64())], ["doc_id", "score", "predicted", "clauses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(keyed(docs, "doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, clauses bigint")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns.

    Null and empty texts have the score of a text without a clause; repeated rows
    stay or go together; an empty table stays empty."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema.names.index("text")

    def run(batches):
        judge = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([judge(t)[0] < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
