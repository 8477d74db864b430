"""Benchmark decontamination with one FM-index per training shard.

A shard is a piece of a partition's documents.  Its symbols are the benchmark's
words; any other word, and every document's end, is a terminator, and each
terminator sorts by its position.  Runs between terminators that are shorter
than the shortest phrase can hold none and are left out of the index.  The
shard's suffix array gives the Burrows-Wheeler transform, a wavelet tree answers
rank, all phrases are searched backwards at once, and occurrences are located by
walking back to sampled suffix positions.  Spans that overlap are merged.

Nothing is shuffled: documents are only scanned.  The benchmark goes to the
executors in blocks of at most ``BLOCK_BYTES`` of text; a larger one is searched
block by block and the spans of a document are merged afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import byte_set, byte_table, join_counted, keyed, pieces, spread, texts, word_hashes, word_runs

U64 = np.uint64
WINDOW = 10
BLOCK_BYTES = 32 << 20
SAMPLE = 8
SHARD_BYTES = 2 << 20
_VALUES = byte_table(lower=True)
_INSIDE = byte_set(lower=True, digits=(48, 57), letters=(97, 122), rest=(128, 255))


# ------------------------------------------------------------------ index


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each zero is a terminator that is smaller
    than any symbol and than every later zero."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rows = np.flatnonzero(symbols)
    left = ends[np.searchsorted(ends, rows)] - rows  # symbols before the terminator
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(len(rows), np.int64)
    padded = np.concatenate([symbols, np.zeros(width, symbols.dtype)]).astype(np.int64)
    for k in range(width):
        key = (key << bits) | np.where(k < left, padded[rows + k], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[ends] = np.arange(len(ends))
    key, tail = key[order], left[order] < width  # with its terminator inside, position decides
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]) | tail[1:] | tail[:-1]
    sa, depth = rows[order], width
    while True:
        # rank: start of the group of equal suffixes
        start = np.flatnonzero(new)
        rank[sa] = len(ends) + np.repeat(start, np.diff(np.append(start, len(sa))))
        size = np.diff(np.append(start, len(sa)))
        if not (size > 1).any():
            return np.concatenate([ends, sa])
        at = spread(start[size > 1], size[size > 1])
        s = sa[at]
        group, following = rank[s], rank[np.minimum(s + depth, n - 1)]
        o = np.lexsort((following, group))
        sa[at] = s[o]
        g, f = group[o], following[o]
        new[at[1:]] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
        new[at[0]] = True
        depth *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, a bit of the symbol at each level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones = bits, []
        s = sequence
        for k in range(bits - 1, -1, -1):
            bit = (s >> k) & 1
            counts = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for k, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            zeros = len(ones) - 1 - ones[-1]
            one = ((symbol >> k) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones in self.ones:
            zeros = len(ones) - 1 - ones[-1]
            one = ones[at + 1] > ones[at]
            out = out * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of a symbol sequence whose last symbol is the terminator 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        before[sa == 0] = 0
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.tree = WaveletTree(before.astype(np.int64), bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << bits)))]).astype(np.int64)
        # sampled positions: every sample-th, and those after a terminator, where no walk goes on
        keep = (sa % sample == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(keep)])
        self.positions = sa[keep]
        self.n = len(symbols)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of equal length), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        # a phrase with a symbol beyond the index's alphabet is nowhere
        live = np.flatnonzero((phrases < len(self.below) - 1).all(axis=1))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            low[live] = self.below[c] + self.tree.rank(c, low[live])
            high[live] = self.below[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            there = self.kept[at + 1] > self.kept[at]
            out[todo[there]] = self.positions[self.kept[at[there]]] + steps
            todo, at = todo[~there], at[~there]
            c = self.tree.access(at)
            at = self.below[c] + self.tree.rank(c, at)
            steps += 1
        return out


# ------------------------------------------------------------------ phrases


class Phrases:
    """The distinct windows of a block of items, as symbols of the block's own words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.names = [i for i, _ in items]
        data, offsets = texts(pa.array([t for _, t in items], pa.large_string()))
        start, end, first = word_runs(data, offsets, _INSIDE)
        hashes = word_hashes(data, start, end, _VALUES)
        self.words, symbol = np.unique(hashes, return_inverse=True)
        symbol = symbol + 1
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for k in range(len(items)):
            s = symbol[first[k] : first[k + 1]].astype(np.int64)
            w = min(window, len(s))
            for i in range(len(s) - w + 1 if w else 0):
                by_length.setdefault(w, {}).setdefault(s[i : i + w].tobytes(), set()).add(k)
        self.groups = []
        for w, found in sorted(by_length.items()):
            owners = [sorted(v) for v in found.values()]
            counts = np.array([len(v) for v in owners])
            self.groups.append((w, np.frombuffer(b"".join(found), np.int64).reshape(-1, w), np.concatenate([[0], np.cumsum(counts)]), np.concatenate(owners)))
        self.shortest = min(by_length, default=0)


def shard_hits(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """For a shard: words of each document, and (document, first word, words, item) of each occurrence."""
    start, end, first = word_runs(data, offsets, _INSIDE)
    n_words = np.diff(first)
    none = np.zeros(0, np.int64)
    if not len(start) or not phrases.shortest:
        return n_words, none, none, none, none
    hashes = word_hashes(data, start, end, _VALUES)
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    symbol = np.where(phrases.words[at] == hashes, at + 1, 0).astype(np.int32)
    # runs of benchmark words inside documents, long enough for the shortest phrase
    known = symbol > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    opens = first[:-1][n_words > 0]
    begin[opens] = known[opens]
    a = np.flatnonzero(begin)
    stop = ~known
    stop[opens] = True
    edges = np.append(np.flatnonzero(stop), len(known))
    z = edges[np.searchsorted(edges, a, "right")]
    long = z - a >= phrases.shortest
    a, size = a[long], (z - a)[long]
    if not len(a):
        return n_words, none, none, none, none
    source = spread(a, size)  # word of each indexed symbol
    place = np.arange(len(source)) + np.repeat(np.arange(len(a)), size)
    text = np.zeros(len(source) + len(a), np.int32)
    text[place] = symbol[source]
    word_at = np.full(len(text), -1, np.int64)
    word_at[place] = source
    index = FMIndex(text)
    docs, words, widths, items = [], [], [], []
    for w, rows, cuts, owners in phrases.groups:
        low, high = index.search(rows)
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        where = word_at[index.locate(spread(low[hit], count))]
        phrase = np.repeat(hit, count)
        doc = np.searchsorted(first, where, "right") - 1
        # one entry per item of a phrase, in a form that keeps each span once with its items
        many = (cuts[1:] - cuts[:-1])[phrase]
        items.append(owners[spread(cuts[phrase], many)])
        docs.append(np.repeat(doc, many))
        words.append(np.repeat(where, many))
        widths.append(np.full(int(many.sum()), w, np.int64))
    return n_words, np.concatenate(docs), np.concatenate(words), np.concatenate(widths), np.concatenate(items)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as sorted disjoint spans."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:] - 1, len(e) - 1)]


_SPANS = "a bigint, z bigint, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _scan(phrases: Phrases):
    def run(batches):
        for b in batches:
            data, offsets = texts(b.column(3))
            counts, starts, ends, items = [], [], [], []
            for i, j in pieces(offsets, SHARD_BYTES):
                part = offsets[i : j + 1]
                n, doc, word, width, item = shard_hits(data[part[0] : part[-1]], part - part[0], phrases)
                base = np.concatenate([[0], np.cumsum(n)])
                counts.append(n)
                o = np.argsort(doc, kind="stable")
                doc, word, width, item = doc[o], word[o], width[o], item[o]
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    x, z = cut[d], cut[d + 1]
                    if x == z:
                        starts.append([])
                        ends.append([])
                        items.append([])
                        continue
                    s, e = merge_spans(word[x:z] - base[d], word[x:z] - base[d] + width[x:z])
                    starts.append(s.tolist())
                    ends.append(e.tolist())
                    items.append(sorted({str(phrases.names[k]) for k in np.unique(item[x:z])}))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["a", "z", "doc_id", "n_words", "starts", "ends", "items"],
            )

    return run


def _join_parts(batches):
    """Spans and items of a document's blocks as one, repeated for each of its rows."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            parts = r.pop("parts")
            pairs = np.array([p for x in parts for p in zip(x["starts"], x["ends"], strict=True)], np.int64).reshape(-1, 2)
            s, e = merge_spans(pairs[:, 0], pairs[:, 1])
            rows.append({**r, "starts": s.tolist(), "ends": e.tolist(), "items": sorted({i for x in parts for i in x["items"]})})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("a", pa.int64()), ("z", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("copies", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark's phrases as broadcast blocks of about half of ``block_bytes`` of text.
    All rows of an item are in one block; rows of one id and text count once."""
    items = keyed(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Phrases([(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()], window))


def _text_key() -> tuple:
    """128 bits that tell a text: rows of one doc_id and text are judged alike."""
    return F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("z")


def _merged(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row for each doc_id and text: spans of all blocks, and how many rows it has.

    Rows are told by what they hold, so blocks agree on them however often the
    documents' plan is evaluated.  Equal parts are combined before the shuffle."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    part = F.struct("starts", "ends", "items")
    found = every.groupBy("a", "z", "doc_id", "n_words").agg((F.count(F.lit(1)) / len(parts)).cast("bigint").alias("copies"), F.collect_set(part).alias("parts"))
    return found.mapInArrow(_join_parts, "a bigint, z bigint, doc_id bigint, n_words bigint, copies bigint, starts array<bigint>, ends array<bigint>, items array<string>")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Word spans of each document that occur in a benchmark item.

    A phrase is ``window`` consecutive words of an item, or a whole shorter
    item.  Returns one row per document: doc_id, n_words, starts, ends (merged
    word spans, ends exclusive), items (ids as strings, each once, sorted).  Null
    or empty texts have no words; items without words match nothing; an item whose
    id is null is named ``null``.  Repeated rows are judged alike.  An empty
    benchmark leaves all clean, an empty table gives none.  Other columns are
    ignored.  The result does not depend on the number of blocks: a larger
    benchmark is one scan of the documents for each block, whose spans are merged.
    """
    sent = list(_blocks(benchmark, window, block_bytes))
    key = _text_key() if len(sent) > 1 else (F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("z"))
    docs = spread_rows(keyed(docs, "doc_id", "text")).select(*key, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = [docs.mapInArrow(lambda it, s=s: _scan(s.value)(it), _SPANS) for s in sent]
    if len(parts) == 1:
        return parts[0].drop("a", "z")
    rows = _merged(docs, parts).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select("doc_id", "n_words", "starts", "ends", "items")


def digest(spans: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and whether any word is hit."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return spans.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def strip_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every contaminated span cut out of the text.

    A removed span runs from its first word's first byte to its last word's last
    byte.  Columns and rows stay, and ``n_chars``, where there is one, follows a
    changed text; texts without a span, null and empty ones are unchanged.  Repeated
    rows are cut alike; an empty benchmark or table changes nothing.

    With one block documents are only scanned.  A larger benchmark is searched
    block by block; then documents are joined with the merged spans of those that
    have any, which moves their texts once.
    """
    sent = list(_blocks(benchmark, window, block_bytes))
    names = docs.schema.names
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def changed(b, new):
        old = b.column(at).to_pylist()
        if count is not None:
            chars = [n if x == y else len(y) for n, x, y in zip(b.column(count).to_pylist(), old, new, strict=True)]
            b = b.set_column(count, b.schema.field(count), pa.array(chars, b.schema.field(count).type))
        return b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    if len(sent) == 1:
        block = sent[0]

        def run(batches):
            for b in batches:
                yield changed(b, _cut(b.column(at), _occurring(block.value)))

        return docs.mapInArrow(run, docs.schema)
    own = keyed(docs, "doc_id", "text").select(*_text_key(), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = [own.mapInArrow(lambda it, s=s: _scan(s.value)(it), _SPANS) for s in sent]
    hits = _merged(own, parts).where("size(starts) > 0").select(F.col("a").alias("__a"), F.col("z").alias("__z"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"), F.col("copies").alias("__copies"))
    # a text's spans are the same under every doc_id
    hits = hits.groupBy("__a", "__z").agg(F.first("__starts").alias("__starts"), F.first("__ends").alias("__ends"), F.sum("__copies").alias("__copies"))
    a, z = _text_key()
    joined = join_counted(docs.withColumns({"__a": a, "__z": z}), hits, ["__a", "__z"], "__copies", "left").select(*docs.columns, "__starts", "__ends")

    def finish(batches):
        for b in batches:
            starts, ends = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            b = b.select(names)
            yield changed(b, _cut(b.column(at), lambda own, edges, i: _given(starts[i:], ends[i:], edges)))

    return joined.mapInArrow(finish, docs.schema)


def _occurring(phrases: Phrases):
    """For a shard: document, first word and word after the last of each occurrence."""

    def of(own, edges, _):
        n_words, doc, word, width, _ = shard_hits(own, edges, phrases)
        word = word - np.concatenate([[0], np.cumsum(n_words)])[doc]
        return doc, word, word + width

    return of


def _given(starts: list, ends: list, edges: np.ndarray):
    """The same from spans by document, whose words are numbered within it."""
    n = len(edges) - 1
    size = np.array([len(s or ()) for s in starts[:n]], np.int64)
    flat = [np.array([x for v in side[:n] for x in v or ()], np.int64) for side in (starts, ends)]
    return np.repeat(np.arange(n), size), *flat


def _cut(column, spans) -> list[str | None]:
    """Texts without the words that ``spans`` tells of each shard."""
    data, offsets = texts(column)
    out = column.to_pylist()
    for i, j in pieces(offsets, SHARD_BYTES):
        part = offsets[i : j + 1]
        own, at = data[part[0] : part[-1]], part - part[0]
        doc, first, last = spans(own, at, i)
        if not len(doc):
            continue
        start, end, base = word_runs(own, at, _INSIDE)
        for d in np.unique(doc):
            s, e = merge_spans(first[doc == d] + base[d], last[doc == d] + base[d])
            kept, done = [], int(at[d])
            for x, z in zip(start[s], end[e - 1], strict=True):
                kept.append(own[done:x].tobytes())
                done = int(z)
            kept.append(own[done : at[d + 1]].tobytes())
            out[i + int(d)] = b"".join(kept).decode("utf-8")
    return out

