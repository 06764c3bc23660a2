"""Exact substring deduplication: every byte goes that is covered by a string of ``length`` bytes which also starts earlier
(smaller doc_id, or in the same document further ahead). Strings do not cross documents, and are judged on the input.

1. Each window of ``length`` bytes names its smallest hash of ``gram`` bytes, the first of equal ones, as its anchor;
   equal windows name equal anchors at the same offset, and so never the same place. Anchors are counted over the corpus in buckets of hashes, one entry a chunk of documents at most. Windows
   whose anchor is found once in the corpus cannot repeat.
2. The others, as runs of windows that name one anchor, go to shards by ranges of anchors, so that equal windows meet in
   one shard. A chunk sends equal runs once; all but the first are repeats. An anchor of more than ``hot`` places is
   split further: its windows go by the bytes that all windows of nearly the same offset from the anchor share.
3. A shard keeps the first of equal runs and sorts the suffixes of all runs by external induced sorting
   (:mod:`worklens.llm.induced`), which gives the common prefixes of neighbours too. Where these reach ``length``, all
   windows but the earliest are repeats. The queues of the induction spill to disk; the text of a shard and the names of
   its samples stay in memory, and the number of shards follows the size of the corpus.
4. Chunks mark the bytes that repeated windows cover.

Shared anchors only decide which windows are sorted; hashes that collide send windows to be sorted that need not be.

Defined results: null and empty texts have no bytes and no spans; null doc_ids come after all others; rows of equal
doc_id are ordered as they are stored; texts shorter than ``length`` are kept whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import flat, induced
from worklens.llm.common import stage, tidied, trimmed
from worklens.llm.lm import _chunked, _packed, _unpacked

_U = np.uint64
_FACTOR = 0xD6E8FEB86659FD93
#: Windows worked through at once, and offsets from an anchor that are split off together where it is hot.
BLOCK, NEAR = 1 << 20, 8


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 50
    chunk: int = 8 << 20
    bucket: int = 16 << 20
    shard: int = 8 << 20
    hot: int = 10_000
    room: int = induced.ROOM


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = _FACTOR
    for _ in range(6):
        inverse = inverse * (2 - _FACTOR * inverse) % (1 << 64)
    tables = []
    for f in (_FACTOR, inverse):
        table = np.full(2 * BLOCK + (2 << 16), f, _U)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=_U))
    return tables[0], tables[1]


_POWERS: list[np.ndarray] = []


class Windows:
    """The runs of windows that name one place, of a stretch of documents: start (in the stretch), number of windows, anchor
    and its place."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, s: Settings):
        if not _POWERS:
            _POWERS.extend(_powers())
        self.raw, self.offsets, self.s = raw, offsets, s
        self.sums = np.append(_U(0), np.cumsum(flat.CODES[raw] * _POWERS[0][: len(raw)], dtype=_U))
        wide, step = s.length - s.gram + 1, 1
        bits = _U(wide.bit_length())
        least = self.grams(np.arange(max(0, len(raw) - s.gram + 1)), s.gram) >> bits << bits  # the offset from the window goes there
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:] + _U(step))
            step *= 2
        if wide > step:
            least = np.minimum(least[: step - wide], least[wide - step :] + _U(wide - step))
        n = max(0, len(raw) - s.length + 1)
        least = least[:n]
        inside = np.zeros(n + 1, np.int32)  # windows that do not leave their document
        low = np.minimum(offsets[:-1], n)
        high = np.maximum(np.minimum(offsets[1:] - s.length + 1, n), low)
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        inside = np.cumsum(inside)[:n] > 0
        place = np.arange(n) + (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        new[offsets[:-1][offsets[:-1] < n]] = True
        self.start = np.flatnonzero(new & inside)
        ends = np.flatnonzero(new | ~inside)
        self.count = np.append(ends, n)[np.searchsorted(ends, self.start, side="right")] - self.start
        # the smallest hashes are small: mixed again, they spread over all buckets
        self.anchor, self.place = flat.mix64(least[self.start] >> bits << bits), place[self.start]

    def grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes at places."""
        return flat.mix64((self.sums[at + size] - self.sums[at]) * _POWERS[1][at])

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of windows, key) of parts of the runs ``own``: windows of nearly equal offset from the anchor,
        and the hash of the bytes that these share."""
        size = self.count[own]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.start[own], size)
        place = np.repeat(self.place[own], size)
        near = (place - at) // NEAR
        new = np.ones(len(at), bool)
        new[1:] = (near[1:] != near[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        key = flat.joined(self.grams(place[first] - NEAR * near[first], self.s.length - NEAR + 1), near[first].astype(_U))
        return at[first], np.diff(np.append(first, len(at))), key


def windows(texts: pa.Array, s: Settings) -> Iterator[tuple[int, int, Windows]]:
    """(document of the first text, bytes of it before, its runs of windows) of stretches of the texts."""
    for a, b, raw, offsets in flat.runs(texts):
        if len(raw) <= 2 * BLOCK:
            yield a, 0, Windows(raw, offsets, s)
        else:
            for low in range(0, len(raw) - s.length + 1, BLOCK):
                part = raw[low : low + BLOCK + s.length - 1]
                yield a, low, Windows(part, np.array([0, len(part)]), s)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _U(32)) * _U(buckets) >> _U(32)


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _anchors(chunked: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """(bucket, chunk, anchors of the bucket's range in order, how often each occurs) of the chunks, or of parts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None

        def cells() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = _bucket_of(keys, buckets)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=_U(buckets))), len(keys)).tolist()
            parts = list(zip(cuts, cuts[1:]))
            columns = [pa.array([int(bucket[a]) for a, _ in parts], pa.int32()), pa.array([last] * len(parts), pa.int64()), pa.array([_packed(np.diff(keys[a:b], prepend=_U(0))) for a, b in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.minimum(counts[a:b], 1 << 30).astype("<u4").tobytes() for a, b in parts], pa.binary())], names=["bucket", "chunk", "keys", "counts"])

        for batch in batches:
            chunks = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(chunks, prepend=-1)).tolist() if len(chunks) else []
            for a, b in zip(cuts, [*cuts[1:], len(chunks)]):
                if held and (last != int(chunks[a]) or size > 2 * s.chunk):
                    yield cells()
                    held, size = [], 0
                last = int(chunks[a])
                texts = batch.column(1).slice(a, b - a)
                held += [w.anchor for _, _, w in windows(texts, s)]
                size += texts.nbytes
        if held:
            yield cells()

    return chunked.select("chunk", "text").mapInArrow(tidied(run), "bucket int, chunk long, keys binary, counts binary")


def _repeated(s: Settings):
    def run(cells: pa.Table) -> pa.Table:
        """The anchors of each chunk that occur twice or more in the corpus, and which are hot."""
        keys = [np.cumsum(_unpacked(k), dtype=_U) for k in cells.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(n, "<u4") for n in cells.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(every := np.concatenate(keys), kind="stable")
        new = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]))
        total = np.empty_like(counts)
        total[order] = np.repeat(np.add.reduceat(counts[order], new), np.diff(np.append(new, len(order))))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        found = [(_packed(np.diff(k[n > 1], prepend=_U(0))), np.packbits(n[n > 1] > s.hot).tobytes()) for k, n in zip(keys, np.split(total, ends))]
        trimmed()
        return pa.table([cells.column("chunk"), pa.array([k for k, _ in found], pa.binary()), pa.array([h for _, h in found], pa.binary())], names=["chunk", "keys", "hot"])

    return run


SENT = "shard int, chunk long, ids binary, unnamed binary, rows binary, starts binary, sizes binary, data binary"
_SENT = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "unnamed", "rows", "starts", "sizes", "data"))])
SPANS = "chunk long, rows binary, starts binary, sizes binary"


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]


def _strings(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each string among the distinct ones, the first of each)."""
    ends = np.append(0, np.cumsum(size))
    code = np.asarray(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode().indices)
    first = np.full(int(code.max(initial=-1)) + 1, len(code))
    np.minimum.at(first, code, np.arange(len(code)))
    return code, first


def _i8(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _of(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<i8")


def _sent(shards: int, s: Settings):
    def run(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        """Runs of windows of a chunk that may repeat: the first of equal ones by shard (ids: doc_ids; unnamed: where
        these are null), the spans of the others without a shard."""
        if not texts.num_rows or not anchors.num_rows:
            return _SENT.empty_table()
        texts = texts.sort_by("row")
        keys = [np.cumsum(_unpacked(k), dtype=_U) for k in anchors.column("keys").to_pylist()]
        hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(k)) for k, h in zip(keys, anchors.column("hot").to_pylist())]).astype(bool)
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys, hot = np.append(keys[order], _U(0)), np.append(hot[order], False)
        parts: list[tuple] = []
        for doc, before, w in windows(_column(texts, "text"), s):
            at = np.minimum(np.searchsorted(keys[:-1], w.anchor), max(0, len(keys) - 2))
            known = (keys[at] == w.anchor) if len(keys) > 1 else np.zeros(len(at), bool)
            plain, warm = np.flatnonzero(known & ~hot[at]), np.flatnonzero(known & hot[at])
            start, count, key = w.split(warm) if len(warm) else (warm, warm, w.anchor[:0])
            start, count, key = np.append(w.start[plain], start), np.append(w.count[plain], count), np.append(w.anchor[plain], key)
            own = np.searchsorted(w.offsets, start, side="right") - 1
            size = count + s.length - 1
            parts.append((own + doc, start - w.offsets[own] + before, size, key, _gathered(w.raw, start, size)))
        doc, start, size, key, data = (np.concatenate(x) for x in zip(*parts))
        del parts
        if not len(doc):
            return _SENT.empty_table()
        ids = _column(texts, "doc_id")
        unnamed = np.asarray(ids.is_null())[doc]
        ids, rows = np.asarray(ids.fill_null(0))[doc], np.asarray(_column(texts, "row"))[doc]
        code, first = _strings(data, size)
        order = np.lexsort((start, rows, ids, unnamed))
        least = np.full(len(first), len(code))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        np.minimum.at(least, code, place)
        chosen = order[least]
        other = np.ones(len(code), bool)
        other[chosen] = False
        chunk = texts.column("chunk")[0].as_py()
        out = [(None, chunk, None, None, _i8(rows[other]), _i8(start[other]), _i8(size[other]), None)] if other.any() else []
        begin = np.cumsum(size) - size
        shard = _bucket_of(key[chosen], shards).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[by], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            c = chosen[by[a:b]]
            out.append((int(shard[by[a]]), chunk, _i8(ids[c]), unnamed[c].astype(np.uint8).tobytes(), _i8(rows[c]), _i8(start[c]), _i8(size[c]), _gathered(data, begin[c], size[c]).tobytes()))
        made = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)
        trimmed()
        return made

    return run


def repeats(texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, room: int) -> np.ndarray:
    """Which places of a text (numbers from 1 that a 0 ends) begin a window that an earlier place begins too. Windows are
    within strings, given by starts and sizes; a number that no string has stands between these."""
    again = np.zeros(len(texts), bool)
    held: list[np.ndarray] = []

    def close() -> None:
        if held and (len(held) > 1 or len(held[0]) > 1):
            group = np.concatenate(held)
            again[group] = True
            again[group.min()] = False
        held.clear()

    for at, common in induced.descending(texts, length, room):
        new = np.flatnonzero(common < length)
        if not len(new):
            held.append(at)
            continue
        held.append(at[: new[0]])
        close()
        size = np.diff(np.append(new, len(at)))
        many = size > 1
        many[-1] = False  # the last may go on
        inside = np.repeat(many, size)
        again[at[new[0] :][inside]] = True
        again[np.minimum.reduceat(at, new)[many]] = False
        held.append(at[new[-1] :])
    close()
    valid = np.zeros(len(texts) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + sizes - length + 1, -1)
    return again & (np.cumsum(valid)[:-1] > 0)


def _found(s: Settings):
    def run(sent: pa.Table) -> pa.Table:
        """The spans that the windows of a shard cover which are repeats."""
        columns = {c: sent.column(c).to_pylist() for c in ("ids", "unnamed", "rows", "starts", "sizes", "data")}
        chunk = np.repeat(np.asarray(_column(sent, "chunk")), [len(x) // 8 for x in columns["ids"]])
        ids, rows, start, size = (_of(columns[c]) for c in ("ids", "rows", "starts", "sizes"))
        unnamed, data = (np.frombuffer(b"".join(columns[c]), np.uint8) for c in ("unnamed", "data"))
        del columns
        order = np.lexsort((start, rows, ids, unnamed))
        begin = (np.cumsum(size) - size)[order]
        chunk, rows, start, size = chunk[order], rows[order], start[order], size[order]
        data = _gathered(data, begin, size)
        _, first = _strings(data, size)
        first = np.sort(first)
        other = np.ones(len(size), bool)
        other[first] = False
        found = [(chunk[other], rows[other], start[other], size[other])]
        begin = (np.cumsum(size) - size)[first]
        size = size[first]
        place = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum()) + len(size) + 1, 255, np.uint8)  # no byte of UTF-8
        text[np.arange(size.sum()) + np.repeat(place - np.cumsum(size) + size, size)] = _gathered(data, begin, size) + 1
        text[-1] = 0
        del data
        again = np.flatnonzero(repeats(text, place, size, s.length, s.room))
        if len(again):
            of = np.searchsorted(place, again, side="right") - 1
            new = np.flatnonzero((np.diff(again, prepend=-2) > 1) | (np.diff(of, prepend=-1) != 0))
            run_of, many = of[new], np.diff(np.append(new, len(again)))
            found.append((chunk[first][run_of], rows[first][run_of], start[first][run_of] + again[new] - place[run_of], many + s.length - 1))
        chunk, rows, start, size = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1)).tolist()
        out = [(int(chunk[order[a]]), *(_i8(x[order[a:b]]) for x in (rows, start, size))) for a, b in zip(cuts, [*cuts[1:], len(order)])]
        trimmed()
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names=["chunk", "rows", "starts", "sizes"])

    return run


REST = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _rest(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """What the spans leave of the texts of a chunk."""
    texts = texts.sort_by("row")
    raw, offsets = flat.bytes_of(_column(texts, "text"))
    n = texts.num_rows
    cover = np.zeros(len(raw) + 1, np.int32)
    if spans.num_rows:
        rows, start, size = (_of(spans.column(c).to_pylist()) for c in ("rows", "starts", "sizes"))
        at = offsets[np.searchsorted(np.asarray(_column(texts, "row")), rows)] + start
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, gone[:-1]) & ~edge[:-1], np.append(gone[1:], False) & ~edge[1:]
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(first - offsets[doc]), pa.array(last - offsets[doc])], names=["start", "end"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pairs)
    left = np.append(0, np.cumsum(~gone))[offsets]
    kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left), pa.py_buffer(raw[~gone])]).cast(pa.binary())
    size = np.diff(offsets)
    out = pa.table([_column(texts, "doc_id"), pa.array(size), pa.array(size - np.diff(left)), listed, kept], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    trimmed()
    return out


def remove(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte offsets, maximal) and kept (the bytes left) of every document."""
    s = settings
    chunked = _chunked(docs, s)
    size = chunked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = _anchors(chunked, size // s.bucket + 1, s)
    repeated = stage(cells.groupBy("bucket").applyInArrow(_repeated(s), "chunk long, keys binary, hot binary"), "repeated")
    sent = stage(chunked.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_sent(size // s.shard + 1, s), SENT), "sent", "zstd")
    found = sent.filter("shard is not null").groupBy("shard").applyInArrow(_found(s), SPANS)
    spans = stage(found.union(sent.filter("shard is null").select("chunk", "rows", "starts", "sizes")), "spans")
    return chunked.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_rest, REST)


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of every document."""
    left = remove(docs, settings)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM r),
n AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
s AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM n GROUP BY doc_id, k),
p AS (
  SELECT s.doc_id, high AS low, coalesce(lead(s.low) OVER (PARTITION BY s.doc_id ORDER BY s.low), len(h) // 2) AS high FROM s JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 0, coalesce(min(low), len(h) // 2) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, h),
k AS (SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS h FROM p JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
