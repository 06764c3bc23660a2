"""Words of many texts at once: numpy passes over the bytes of an Arrow string column.

Nothing here makes a Python object per word. A column is worked through in runs of whole documents of
about ``RUN_BYTES``; a longer document is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_POWERS = 1 << 16

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    powers = np.full(_POWERS, 0xD6E8FEB86659FD93, dtype=np.uint64)
    powers[0] = 1
    return codes, np.cumprod(powers, dtype=np.uint64)


CODES, POWERS = _tables()


class Words(NamedTuple):
    """Words of a run of documents, in order: document (index in the run), hash, and byte range."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, their bytes, their offsets) of each run."""
    raw, offsets = bytes_of(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + RUN_BYTES, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_table(pattern_bytes: bytes | None = None, *, breaks: bytes | None = None) -> np.ndarray:
    """Which of the 256 bytes belong to words: those given, or all but the breaks."""
    table = np.zeros(256, dtype=bool) if breaks is None else np.ones(256, dtype=bool)
    table[np.frombuffer(pattern_bytes if breaks is None else breaks, dtype=np.uint8)] = breaks is None
    return table


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, singles: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes within documents, with A-Z read as a-z.

    ``singles``: bytes of which each run of equal ones is a word too (punctuation)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    raw = LOWER[raw]
    kind = table[raw].astype(np.int16)
    if singles is not None:
        kind = np.where(singles[raw], raw.astype(np.int16) + 2, kind)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    size = end - start
    at = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))[: n - start[0]] if start[0] == 0 else None
    if at is None:
        at = np.zeros(n, np.int64)
        at[start[0] :] = np.arange(n - start[0]) - np.repeat(start - start[0], np.diff(np.append(start, n)))
    coded = CODES[raw]
    coded *= POWERS[at & (_POWERS - 1)] + (at >> 16).astype(np.uint64) * U64(2)
    coded[kind == 0] = 0
    hashed = mix64(np.add.reduceat(coded, start) + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, hashed, start, end)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix64(mix64(a + U64(0x632BE59BD9B4E019)) + b * U64(0xD1342543DE82EF95))
