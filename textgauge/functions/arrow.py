"""Arrow-batched Python functions whose types are read only when they are used."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that are Python objects at once; a longer text is a piece of its own.
PIECE = 1 << 20


def pieces(texts: pa.Array, *more: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of a batch with about ``PIECE`` bytes of ``texts`` and the same rows of ``more``.

    A batch has as many rows as Spark sends, however long they are; what Python makes
    of a slice is given back before the next one, so memory doesn't grow with the batch."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = before[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(before, done + PIECE, "right")))
        yield tuple(c.slice(at, end - at) for c in (texts, *more))
        at = end


def arrow_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a column function of a row function; rows travel in Arrow batches.
    A type's text needs a session to be read, so that waits for the first use."""

    def make(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def on_columns(*columns) -> Column:
            return F.udf(f, returnType=returns, useArrow=True)(*columns)

        return on_columns

    return make


def text_function(returns: str, kind: pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """Make a column function of a row function whose first column is text, which may be long.

    Rows become Python objects by pieces of a batch, so that no more than a piece is held."""

    def make(f: Callable) -> Callable[..., Column]:
        def on_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                for piece in pieces(*(batch if isinstance(batch, tuple) else (batch,))):
                    yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in piece), strict=True)], kind)

        @wraps(f)
        def on_columns(*columns) -> Column:
            return F.arrow_udf(on_batches, returnType=returns)(*columns)

        return on_columns

    return make


def list_function(returns: str, fields: dict[str, pa.DataType] | pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """Make a column function of a function from a text to a list of values or tuples.

    The lists of a piece of a batch become one Arrow array at once, so that no more
    than a piece's tokens are held.  Null texts give empty lists."""

    def make(f: Callable) -> Callable[..., Column]:
        def lists(texts: pa.Array) -> pa.Array:
            offsets, flat = [0], []
            for t in texts.to_pylist():
                flat += f(t)
                offsets.append(len(flat))
            if isinstance(fields, dict):
                columns = list(zip(*flat, strict=True)) if flat else [[] for _ in fields]
                values = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, fields.values(), strict=True)], list(fields))
            else:
                values = pa.array(flat, fields)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        def on_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for (texts,) in pieces(batch):
                    yield lists(texts)

        @wraps(f)
        def on_columns(column) -> Column:
            return F.arrow_udf(on_batches, returnType=returns)(column)

        return on_columns

    return make
