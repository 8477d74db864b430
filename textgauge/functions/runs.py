"""Longest runs of a character and of a repeated unit, a batch of texts at a time.

The batch is one array of code points.  For a unit of u characters, places that equal
the place u further on form stretches, found by where such equality begins and ends;
a stretch of n such places is a run of n // u + 1 units, and of the starts with as many
units the first counts.  Stretches end with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Found = tuple[str, int, int, int, int, int]

#: Characters that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > PIECE:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _stretches(points: np.ndarray, ends: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of places that equal the place ``unit`` on."""
    if len(points) <= unit:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(points) + 1, np.int8)
    same[: len(points) - unit] = points[:-unit] == points[unit:]
    # no place looks beyond its text
    for back in range(1, unit + 1):
        at = ends - back
        same[at[at >= 0]] = 0
    turns = np.flatnonzero(np.diff(same, prepend=np.int8(0)))
    return turns[::2], turns[1::2] - turns[::2]


def longest_runs(texts: list[str | None], most: int = 16, repeats: int = 16, covers: int = 128) -> list[tuple[Found | None, Found | None]]:
    """For each text the first longest run of a character, and of the units of 2 to
    ``most`` characters that repeat often enough the one that covers most, then the
    shortest, then the first: (unit, unit length, repeats, covered, start, end).

    Null and empty texts have none.
    """
    own = [t or "" for t in texts]
    out: list[tuple[Found | None, Found | None]] = []
    for i, j in _pieces(own):
        out += _of_piece(own[i:j], most, repeats, covers)
    return out


def _of_piece(texts: list[str], most: int, repeats: int, covers: int) -> list[tuple[Found | None, Found | None]]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    first = ends - np.array([len(t) for t in texts], np.int64)
    character: list[Found | None] = [(t[0], 1, 1, 1, 0, 1) if t else None for t in texts]
    start, size = _stretches(points, ends, 1)
    text = np.searchsorted(ends, start, "right")
    order = np.lexsort((start, -size, text))
    for k in order[np.unique(text[order], return_index=True)[1]].tolist():
        t, a, n = int(text[k]), int(start[k] - first[text[k]]), int(size[k]) + 1
        character[t] = texts[t][a], 1, n, n, a, a + n
    best: list[tuple[tuple, Found] | None] = [None] * len(texts)
    for unit in range(2, most + 1):
        start, size = _stretches(points, ends, unit)
        count = size // unit + 1
        for k in np.flatnonzero((size > 0) & (count >= repeats) & (count * unit >= covers)).tolist():
            t = int(np.searchsorted(ends, start[k], "right"))
            a, n = int(start[k] - first[t]), int(count[k])
            rank = n * unit, -unit, -a
            if best[t] is None or rank > best[t][0]:
                best[t] = rank, (texts[t][a : a + unit], unit, n, n * unit, a, a + n * unit)
    return [(c, b and b[1]) for c, b in zip(character, best, strict=True)]


def longest_character_run(text: str) -> Found | None:
    """The first longest run of one character."""
    return longest_runs([text])[0][0]


def longest_unit_run(text: str, most: int = 16, repeats: int = 16, covers: int = 128) -> Found | None:
    """The run of a unit of 2 to ``most`` characters that covers most."""
    return longest_runs([text], most, repeats, covers)[0][1]
