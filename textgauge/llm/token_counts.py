"""Token counts by dynamic programming shared over a trie of pre-tokens.

A text's pre-tokens are its runs of non-space characters, each with a leading
``▁``.  The distinct ones of a batch are walked in sorted order, which is a walk of
their trie: a prefix that two of them share is one path from the root, and its
forward scores (best log probability and fewest pieces that reach it) are worked
out once.  At a pre-token's last node the piece count is stored, and a text's
count is the sum over its pre-tokens.

The vocabulary is a public piece table; its pieces are ranked by frequency, and a
piece's unigram probability follows Zipf's law in that rank.  A character that no
piece covers costs one piece for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from textgauge.sources.layout import spread_rows

from .common import keyed

SPACE = "▁"
#: Characters of text whose pre-tokens are walked together, and pre-tokens remembered between walks.
BATCH_CHARS, REMEMBERED = 1 << 20, 200_000
#: Pre-tokens beyond this length share no prefix that is worth a path; they are scored alone.
LONG = 512
_OFFSET = 2.7


def load_pieces(path: str | None = None) -> dict[str, float]:
    """Pieces with their unigram log probabilities, from a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    # pieces stand in the order of their merges; single characters end the table
    total = math.log(sum(1 / (k + _OFFSET) for k in range(len(kept))))
    return {p: -math.log(k + _OFFSET) - total for k, p in enumerate(kept)}


class TrieCounter:
    """Piece counts of pre-tokens on their best unigram path; ties take fewer pieces."""

    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - 10.0
        # pieces by their characters from last to first
        self.backward: dict = {}
        for p, score in pieces.items():
            node = self.backward
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = score
        self.singles = {p for p in pieces if len(p) == 1}

    def _extend(self, word: str, at: int, scores: list[float], counts: list[int]) -> None:
        """Forward scores of the nodes after character ``at`` of a path."""
        backward, byte, singles = self.backward, self.byte, self.singles
        for end in range(at, len(word)):
            c = word[end]
            if c in singles:
                best, fewest = -math.inf, 0
            else:
                n = len(c.encode("utf-8", "surrogatepass"))
                best, fewest = scores[end] + n * byte, counts[end] + n
            node, start = backward, end
            while start >= 0:
                node = node.get(word[start])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    s, k = scores[start] + piece, counts[start] + 1
                    if s > best or (s == best and k < fewest):
                        best, fewest = s, k
                start -= 1
            scores.append(best)
            counts.append(fewest)

    def count(self, words: Iterable[str]) -> dict[str, int]:
        """Terminal counts of the distinct ``words``."""
        out: dict[str, int] = {}
        scores, counts, last = [0.0], [0], ""
        for word in sorted(set(words)):
            path = SPACE + word
            if len(path) > LONG:
                s, k = [0.0], [0]
                self._extend(path, 0, s, k)
                out[word] = k[-1]
                continue
            shared, most = 0, min(len(last), len(path))
            while shared < most and last[shared] == path[shared]:
                shared += 1
            del scores[shared + 1 :], counts[shared + 1 :]
            self._extend(path, shared, scores, counts)
            out[word] = counts[-1]
            last = path
        return out


def count_texts(texts: list[str | None], counter: TrieCounter, known: dict[str, int]) -> list[tuple[int, int]]:
    """Tokens and pre-tokens of each text; ``known`` carries terminal counts over."""
    out, i = [], 0
    while i < len(texts):
        split, size = [], 0
        while i < len(texts) and (not split or size < BATCH_CHARS):
            split.append((texts[i] or "").split())
            size += len(texts[i] or "")
            i += 1
        new = set().union(*split) - known.keys()
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set().union(*split)
            known.update(counter.count(new))
        out += [(sum(map(known.__getitem__, words)), len(words)) for words in split]
    return out


def token_counts(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """Tokens of every whole text: doc_id, n_tokens, n_pretokens.

    Null, empty and blank texts have none.  Repeated rows are counted alike;
    other columns are ignored.  ``pieces`` (log probability by piece, 32,000 by
    default) goes to the executors once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces() if pieces is None else pieces)

    def run(batches):
        counter, known = TrieCounter(sent.value), {}
        for b in batches:
            rows = count_texts(b.column(1).to_pylist(), counter, known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(keyed(docs, "doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_pretokens bigint")
