"""Induced sorting of the suffixes of a text, with their common prefixes, on queues that spill to disk.

The text is a sequence of numbers from 1; a 0 that ends it is smaller than all. A suffix is of type S if it is smaller
than the next one, else of type L; an S suffix after an L one is a sample.

1. The parts of the text from sample to sample are named in their order, 7 numbers at a time. If names repeat, the
   sequence of names is sorted in turn: by the same induction where names are few for its length, else by doubling of
   sorted prefixes. Common prefixes of neighbouring samples are read off the text.
2. Scanned in ascending order, each suffix i pushes i - 1, if that is of type L, to the queue of its first number; the
   queues are popped in ascending order, samples after the L suffixes of a number. So a queue keeps its tuples
   (suffix, common prefix with the one before) in their final order. Of two tuples of a queue the common prefix is one
   more than the least common prefix between the suffixes that pushed them.
3. In descending order S suffixes are pushed in the same way. Suffixes are handed out in this order.

The queues are a monotone priority queue: beyond ``room`` tuples it writes what it holds to a file, number by number,
and reads it back in blocks. Orders and common prefixes hold up to ``cap`` numbers; suffixes that agree in more come in
any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Tuples that a queue keeps in memory, and tuples worked through at once.
ROOM, BLOCK = 4 << 20, 1 << 18


class DiskQueue:
    """Tuples (suffix, common prefix) by number, first in first out."""

    def __init__(self, numbers: int, room: int = ROOM):
        self.parts: list[list] = [[] for _ in range(numbers)]
        self.room, self.held, self.file, self.kind = room, 0, None, np.dtype([("at", "<i8"), ("lcp", "<i2")])

    def push(self, number: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[number].append((at, lcp))
        self.held += len(at)
        if self.held > self.room:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            kept = [p for p in parts if len(p) == 2]
            if kept:
                rows = np.empty(sum(len(at) for at, _ in kept), self.kind)
                rows["at"], rows["lcp"] = np.concatenate([at for at, _ in kept]), np.concatenate([lcp for _, lcp in kept])
                where = self.file.tell()
                self.file.write(rows.tobytes())
                spilled = [p for p in parts if len(p) == 3]  # older than all that memory holds
                parts[:] = [*spilled, ("disk", where, len(rows))]
        self.held = 0

    def _read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            return part
        self.file.seek(part[1])
        rows = np.frombuffer(self.file.read(part[2] * self.kind.itemsize), self.kind)
        return rows["at"].copy(), rows["lcp"].copy()

    def pop(self, number: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a number, about BLOCK of them."""
        parts, got, n = self.parts[number], [], 0
        while parts and n < BLOCK:
            part = parts.pop(0)
            size = part[2] if len(part) == 3 else len(part[0])
            if len(part) == 3 and size > BLOCK:
                parts.insert(0, ("disk", part[1] + BLOCK * self.kind.itemsize, size - BLOCK))
                part = ("disk", part[1], BLOCK)
            got.append(self._read(part))
            if len(part) == 2:
                self.held -= len(part[0])
            n += len(got[-1][0])
        if not got:
            return None
        return got[0] if len(got) == 1 else (np.concatenate([a for a, _ in got]), np.concatenate([c for _, c in got]))

    def last_first(self, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a number in the opposite order; they stay."""
        for part in self.parts[number][::-1]:
            size = part[2] if len(part) == 3 else len(part[0])
            for high in range(size, 0, -BLOCK):
                low = max(0, high - BLOCK)
                at, lcp = self._read(("disk", part[1] + low * self.kind.itemsize, high - low)) if len(part) == 3 else (part[0][low:high], part[1][low:high])
                yield at[::-1], lcp[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """Least common prefix since the last push to each queue, along a scan."""

    def __init__(self, numbers: int, cap: int):
        self.since, self.cap = np.full(numbers, -1, np.int64), cap  # -1: nothing pushed yet, and so nothing in common

    def pushed(self, lcp: np.ndarray, where: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Common prefixes of the tuples that the scanned suffixes number ``where`` push, ordered by queue and place, to
        the queues ``number``; lcp: of all scanned suffixes with the one scanned before."""
        if not len(where):
            np.minimum(self.since, lcp.min(initial=32767), out=self.since)
            return lcp[:0]
        table = [lcp]
        while len(table[-1]) > (step := 1 << (len(table) - 1)):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        first = np.diff(number, prepend=-1) != 0
        low = np.where(first, 0, np.append(0, where[:-1]) + 1)
        size = where - low + 1
        level = np.frexp(size)[1] - 1  # of the largest power of two within
        least = np.empty(len(where), np.int16)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            least[own] = np.minimum(table[k][low[own]], table[k][where[own] + 1 - (1 << k)])
        begins = np.flatnonzero(first)
        queues = number[begins]
        least[begins] = np.minimum(least[begins], self.since[queues])
        np.minimum(self.since, lcp.min(), out=self.since)
        ends = np.append(begins[1:], len(number)) - 1
        after = np.minimum.accumulate(lcp[::-1])[::-1]
        self.since[queues] = np.append(after, 32767)[where[ends] + 1]
        return np.minimum(least + 1, self.cap).astype(np.int16)


def _pushes(queue: DiskQueue, least: _Least, text: np.ndarray, at: np.ndarray, lcp: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Push the suffixes before those scanned."""
    previous = np.maximum(at - 1, 0)
    number = text[previous]
    where = np.flatnonzero((at > 0) & wanted(number, at))
    number = number[where]
    order = np.argsort(number, kind="stable")
    where, number = where[order], number[order].astype(np.int64)
    common = least.pushed(lcp, where, number)
    previous = previous[where]
    cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(number)]):
        queue.push(int(number[a]), previous[a:b], common[a:b])


def _runs(text: np.ndarray, at: int, cap: int) -> int:
    """How often the number of a place repeats from there on."""
    part = text[at : at + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text: np.ndarray, numbers: int, samples: np.ndarray, common: np.ndarray, cap: int, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, in descending order: blocks of (suffix, common prefix with the one handed out before).
    ``samples``: in order, the last suffix (the final 0) first; ``common``: of each with the one before."""
    queue, done, least = DiskQueue(numbers, room), DiskQueue(numbers, room), _Least(numbers, cap)
    edge = np.searchsorted(text[samples], np.arange(numbers + 1))
    greatest: dict[int, int] = {}  # L suffix of a number
    for c in range(numbers):
        while (block := queue.pop(c)) is not None:
            at, lcp = block
            done.push(c, at, lcp)
            greatest[c] = int(at[-1])
            _pushes(queue, least, text, at, lcp, lambda number, _: number >= c)
        for low in range(edge[c], edge[c + 1], BLOCK):
            at, lcp = samples[low : min(low + BLOCK, edge[c + 1])], common[low : min(low + BLOCK, edge[c + 1])].copy()
            if low == edge[c]:
                lcp[0] = min(_runs(text, greatest[c], cap), _runs(text, int(at[0]), cap)) if c in greatest else 0
            _pushes(queue, least, text, at, lcp, lambda number, _: number > c)
    queue.close()
    queue, least = DiskQueue(numbers, room), _Least(numbers, cap)
    for c in range(numbers - 1, 0, -1):
        smallest = None  # S suffix of the number
        while (block := queue.pop(c)) is not None:
            at, lcp = block
            smallest = int(at[-1])
            yield at, lcp
            _pushes(queue, least, text, at, lcp, lambda number, _: number <= c)
        before = None  # common prefix of the suffixes scanned last and next
        for at, lcp in done.last_first(c):
            if before is None:
                before = min(_runs(text, greatest[c], cap), _runs(text, smallest, cap)) if smallest is not None else 0
            lcp = np.append(np.int16(before), lcp)
            before, lcp = int(lcp[-1]), lcp[:-1]
            yield at, lcp
            _pushes(queue, least, text, at, lcp, lambda number, _: number < c)
    queue.close()
    done.close()


def samples_of(text: np.ndarray) -> np.ndarray:
    """The samples, by place; the final 0 is one."""
    n = len(text)
    up = np.empty(n, np.int8)
    np.subtract(text[1:] > text[:-1], text[1:] < text[:-1], out=up[:-1], dtype=np.int8)
    up[-1] = 1
    if n > 1 and (up == 0).any():  # equal neighbours are of the type of the last of them
        there = np.flatnonzero(up)
        up = up[np.repeat(there, np.diff(there, prepend=-1))]
    return np.flatnonzero((up[1:] > 0) & (up[:-1] < 0)) + 1


def _ranked(x: np.ndarray) -> np.ndarray:
    """Dense ranks, from 0."""
    coded = pa.array(x).dictionary_encode()
    order = np.argsort(np.asarray(coded.dictionary), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[np.asarray(coded.indices)]


def _named(text: np.ndarray, numbers: int, samples: np.ndarray) -> np.ndarray:
    """Names, from 0, of the parts of the text from each sample to the next. A part that goes on is smaller than one that
    ends there: it goes on with an L suffix of the same number."""
    size = np.append(np.diff(samples) + 1, 1)
    bits = int(numbers + 1).bit_length()
    word = 63 // bits
    rank, deeper = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range((int(size.max()) - 1) // word, -1, -1):
        own = np.flatnonzero(size > depth * word)
        key = np.zeros(len(own), np.int64)
        for k in range(depth * word, (depth + 1) * word):
            inside = size[own] > k
            key = (key << bits) | np.where(inside, text[np.minimum(samples[own] + k, len(text) - 1)].astype(np.int64), numbers)
        key = _ranked(key)
        if len(deeper):
            goes_on = np.full(len(own), int(rank.max()) + 1)
            goes_on[np.searchsorted(own, deeper)] = rank
            key = _ranked(key * (int(rank.max()) + 2) + goes_on)
        rank, deeper = key, own
    return rank


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Suffixes of the names in order, up to ``cap`` names: those that still tie are sorted by what follows."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = np.flatnonzero(np.diff(names[order], prepend=-1))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n))) + 1
    size = np.diff(np.append(first, n))
    active = order[np.repeat(size > 1, size)]
    h = 1
    while h < cap and len(active):
        key = (rank[active] << np.int64(32)) | rank[np.minimum(active + h, n)] if n < 1 << 31 else None
        by = np.argsort(key, kind="stable") if key is not None else np.lexsort((rank[np.minimum(active + h, n)], rank[active]))
        active = active[by]
        own, following = rank[active], rank[np.minimum(active + h, n)]
        group = np.flatnonzero(np.diff(own, prepend=-1))
        new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(following, prepend=-1) != 0))
        size = np.diff(np.append(new, len(active)))
        offset = new - group[np.searchsorted(group, new, side="right") - 1]
        rank[active] = own + np.repeat(offset, size)
        order[rank[active] - 1 + np.arange(len(active)) - np.repeat(new, size)] = active
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return order


def _common(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours in an order, read off a text of bytes eight at a time."""
    data = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros(len(order), np.int16)
    own = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for done in range(0, cap, 8):
        x = words[a + done] ^ words[b + done]
        same = x == 0
        out[own[~same]] = done + (np.bitwise_count((x[~same] & -x[~same]) - np.uint64(1)) >> 3)
        own, a, b = own[same], a[same], b[same]
        out[own] = done + 8
        further = np.maximum(a, b) + done + 8 < len(text)
        own, a, b = own[further], a[further], b[further]
    return np.minimum(out, cap)


def sorted_samples(text: np.ndarray, numbers: int, cap: int, room: int = ROOM) -> np.ndarray:
    """The samples in the order of their suffixes."""
    samples = samples_of(text)
    names = _named(text, numbers, samples)
    count = int(names.max()) + 1
    if count == len(names):
        return samples[np.argsort(names)]
    if count * 64 > len(names):
        return samples[_doubled(names, cap)]
    inner = sorted_samples(names, count, cap, room)
    blocks = [at for at, _ in induce(names, count, inner, np.zeros(len(inner), np.int16), cap, room)]
    return samples[np.concatenate([*blocks, [len(names) - 1]])[::-1]]


def descending(text: np.ndarray, cap: int, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a text of bytes from 1, which a 0 ends, in descending order, and their common prefixes (at most
    ``cap``) with the one before: see :func:`induce`."""
    samples = sorted_samples(text, 256, cap, room)
    yield from induce(text, 256, samples, _common(text, samples, cap), cap, room)
