"""Language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary for each language holds labelled text of that language.
A text is cut into segments, each is compressed with every dictionary, and the
language whose sizes sum to the least is predicted.  Segments are short, so that
a long text is measured against the dictionaries and not against itself; all of
them count.  A prediction whose margin over the second is narrow is rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import draw_distinct, keyed

#: Bounds of the labelled sample: documents of each language, and the bytes beyond which an
#: excerpt of as many characters stands for a document.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 16384
DICTIONARY_BYTES = 112 << 10
SEGMENT = 1024
LEVEL = 9
#: A margin under this share of the best size is too narrow to accept.
NARROW = 0.01
UNKNOWN = "und"
_BLANK = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """Lower-case UTF-8 with everything ASCII that is no letter as a space; empty
    where the text has no letter at all."""
    if not text:
        return b""
    raw = " ".join(text.lower().encode("utf-8").translate(_BLANK).decode("utf-8").split())
    if not any(c.isalpha() for c in raw[:64]) and not any(c.isalpha() for c in raw):
        return b""
    return raw.encode("utf-8")


class Dictionaries:
    """Compressors by language, most frequent first; built in each worker from raw content."""

    def __init__(self, raw: dict[str, bytes]):
        self.names = list(raw)
        self.tools = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(raw[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, body: bytes) -> list[int]:
        total = [0] * len(self.tools)
        for i in range(0, len(body), SEGMENT):
            piece = body[i : i + SEGMENT]
            for k, tool in enumerate(self.tools):
                total[k] += len(tool.compress(piece))
        return total

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough to accept it."""
        body = letters(text)
        if not body or not self.names:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(body)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        weights = [math.exp(-(s - best) / (2 + 0.02 * best)) for s in sizes]
        margin = (sizes[order[1]] - best) / max(1, best) if len(sizes) > 1 else 1.0
        return self.names[order[0]], 1 / sum(weights), margin >= NARROW


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content by language from a bounded sample of labelled documents.

    Every label with a text that has a letter counts.  Of each, about twice
    ``SAMPLE_DOCS`` different texts are drawn by their hash, so the draw is the same
    for any partitioning and however often a text is repeated; of texts beyond
    ``SAMPLE_BYTES`` an excerpt is taken.  Null labels, the label ``und``, and null,
    empty and letterless texts teach nothing.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counts, drawn = draw_distinct(usable, "lang", 17, 2 * SAMPLE_DOCS, SAMPLE_BYTES)
    out: dict[str, bytes] = {}
    for row in drawn.orderBy("lang", "h", "text").toLocalIterator():
        body = out.get(row.lang, b"")
        if len(body) < DICTIONARY_BYTES:
            out[row.lang] = body + letters(row.text) + b" "
    # the most frequent label first, as it wins ties
    return {k: out[k][:DICTIONARY_BYTES] for k in counts if out.get(k, b"").strip()}


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Predict the language of every text from the dictionaries of ``labelled``.

    Takes ``doc_id`` and ``text``; ``labelled`` has ``text`` and ``lang``.
    Returns one row per input row: doc_id, lang_pred, score (0 to 1; the best
    language's share of the weights of all), accepted (false where the margin is
    narrow).  Null texts and texts without a letter are ``und`` with score 0, as
    are all texts where nothing is labelled.  Ties go to the more frequent
    label, of equal ones to the name that sorts first.  Other columns are ignored.
    """
    raw = docs.sparkSession.sparkContext.broadcast(learn(keyed(labelled, "lang", "text")))

    def run(batches):
        tools = Dictionaries(raw.value)
        for b in batches:
            judged = [tools.judge(t) for t in b.column(1).to_pylist()]
            names, scores, accepted = zip(*judged, strict=True) if judged else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.array(scores, float)), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(keyed(docs, "doc_id", "text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
