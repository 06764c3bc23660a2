"""Stupid-backoff language model: n-gram counts partitioned by hash, joined to the documents' n-grams, summed
per document.

A document is scored by what the rest of the corpus holds. With C(g) the occurrences of an n-gram in all
documents, those of the document itself taken off, and N the number of words of the corpus,

    S(w | context) = C(context w) / C(context)  where C(context w) > 0
                   = alpha * S(w | context without its first word)  elsewhere;  S(w) = max(C(w), 1) / N

so that no text is evidence for itself, and every word and n-gram counts: there is no vocabulary, and no n-gram is
left out. Production uses trigrams.

Documents are dealt into chunks of about CHUNK bytes of text, in the order in which they are stored. The n-grams
of all orders of a chunk are exploded, counted and dealt by hash into as many buckets as the size of the corpus
asks for. An n-gram is a 64-bit hash; those of a chunk that fall into one bucket travel as one row, which holds
their sorted hashes and counts as arrays (the differences of neighbours, byte by byte, which Spark's codec packs
well). A bucket's task adds up the counts of all chunks and joins the sums back to each chunk's n-grams; the sums,
in the order of the hashes, go to the chunk, whose task finds the same n-grams in its documents again. A bucket
holds a share of the hashes and at most one count of an n-gram from each chunk, so no n-gram, however common, and
no document gathers more than that in one task.

Words: runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Defined results: null, empty or wordless texts have 0 words and null scores; a null doc_id passes through;
repeated rows are documents of their own, and each counts for the other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import flat
from worklens.llm.common import stage, text_batches, tidied, trimmed

LETTERS = flat.word_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
#: Bytes of text in a chunk, and in a bucket's share of the corpus. They bound the memory of a task.
CHUNK = 12 << 20
BUCKET = 4 << 20


@dataclass(frozen=True)
class Settings:
    order: int = 3
    alpha: float = 0.4
    chunk: int = CHUNK
    bucket: int = BUCKET


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers, all their lowest bytes first, then the next ones."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word of the texts, in order."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, _, raw, offsets in flat.runs(column):
        w = flat.words(raw, offsets, LETTERS)
        docs.append(w.doc + a)
        hashes.append(w.hash)
    return np.concatenate(docs), np.concatenate(hashes)


def _ngrams(doc: np.ndarray, word: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (places at which its n-grams end, their hashes); hashes of all orders are told apart."""
    key = flat.mix64(word + np.uint64(1))
    yield np.arange(len(word)), key
    for n in range(2, order + 1):
        key = flat.joined(key[:-1], word[n - 1 :])
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        yield np.flatnonzero(inside) + n - 1, key[inside]


def _chunked(docs: DataFrame, s: Settings) -> DataFrame:
    """row, chunk, doc_id, text: rows of a chunk follow each other and hold about ``s.chunk`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = chunk = TaskContext.get().partitionId() << 32
        held = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + held
            chunks = chunk + ends // s.chunk
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ends))), pa.array(chunks), *batch.columns], names=["row", "chunk", "doc_id", "text"])
            row += len(ends)
            held = int(ends[-1]) if len(ends) else held

    source = text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return stage(source.mapInArrow(tidied(run), "row long, chunk long, doc_id long, text string"), "chunks", "zstd")


CELLS = "bucket int, chunk long, piece long, n int, words long, keys binary, counts binary"


def _cells(chunked: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """The n-grams of each chunk by order and bucket. ``piece``: the first row of those read together, as a file may be
    split inside a chunk; words: the number of words of the piece, in one of its rows."""

    def exploded(chunk: int, piece: int, texts: list) -> Iterator[pa.RecordBatch]:
        doc, word = _words(pa.chunked_array(texts).combine_chunks())
        names, kinds = zip(*(c.split() for c in CELLS.split(", ")))
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        for n, (_, keys) in enumerate(_ngrams(doc, word, s.order), 1):
            keys, counts = np.unique(keys, return_counts=True)
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))), len(keys))
            rows = [(int(bucket[a]), chunk, piece, n, len(word) if n == 1 and not a else 0, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, piece, last, texts = None, 0, -1, []
        for batch in batches:
            rows, chunks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(chunks, prepend=-1) | (np.diff(rows, prepend=rows[:1] - 1) < 0)).tolist() if len(rows) else []
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                if chunks[a] != chunk or rows[a] < last:
                    if texts:
                        yield from exploded(chunk, piece, texts)
                    chunk, piece, texts = int(chunks[a]), int(rows[a]), []
                texts.append(batch.column(2).slice(a, b - a))
                last = int(rows[b - 1])
        if texts:
            yield from exploded(chunk, piece, texts)

    return chunked.select("row", "chunk", "text").mapInArrow(tidied(run), CELLS)


SUMS = "bucket int, chunk long, piece long, n int, words long, sums binary"


def _summed(cells: pa.Table) -> pa.Table:
    """A bucket's n-grams counted over all chunks; each chunk gets the sums of its own, in order."""
    keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in cells.column("keys").to_pylist()]
    counts = np.concatenate([_unpacked(n) for n in cells.column("counts").to_pylist()])
    order = np.argsort(every := np.concatenate(keys), kind="stable")
    new = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]))
    sums = np.empty_like(counts)
    sums[order] = np.repeat(np.add.reduceat(counts[order], new), np.diff(np.append(new, len(order))))
    ends = np.cumsum([len(k) for k in keys])
    packed = [_packed(x) for x in np.split(sums, ends[:-1])]
    trimmed()
    return cells.select(["bucket", "chunk", "piece", "n", "words"]).append_column("sums", pa.array(packed, pa.binary()))


def _left(doc: np.ndarray, ends: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each place, the count of the n-gram that ends there without those of its own document, 0 where none ends.
    ``sums``: the counts in the order of the hashes."""
    left = np.zeros(len(doc), np.int64)
    if len(keys):
        order = np.argsort(keys, kind="stable")  # within an n-gram, its documents follow each other
        keys, ends = keys[order], ends[order]
        new, owner = np.diff(keys, prepend=~keys[:1]) != 0, doc[ends]
        cuts = np.flatnonzero(new | (np.diff(owner, prepend=-1) != 0))
        own = np.diff(np.append(cuts, len(order)))
        of = np.cumsum(new)[cuts] - 1
        if of[-1] + 1 != len(sums):
            raise ValueError("sums of other n-grams than those of the documents")
        left[ends] = np.repeat(sums[of] - own, own)
    return left


def _scored(doc: np.ndarray, word: np.ndarray, n_docs: int, sums: dict[int, np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: words, words that no other document has, words scored by their own counts alone, and the
    log score without the 1 / N of the latter. ``sums``: by order, see :func:`_left`."""
    n_words = np.bincount(doc, minlength=n_docs)
    place = np.minimum(np.arange(len(doc)) - (np.cumsum(n_words) - n_words)[doc], s.order - 1)
    scores, shorter = np.zeros(len(doc)), np.zeros(0, np.int64)
    alone, unknown = np.ones(len(doc), bool), np.zeros(len(doc), bool)
    for n, (ends, keys) in enumerate(_ngrams(doc, word, s.order), 1):
        left = _left(doc, ends, keys, sums.get(n, shorter[:0]))
        if n == 1:
            unknown = left <= 0
            scores = np.log(np.maximum(left, 1)) + place * np.log(s.alpha)
        else:
            hit = np.flatnonzero(left > 0)
            scores[hit] = np.log(left[hit]) - np.log(shorter[hit - 1]) + (place[hit] - (n - 1)) * np.log(s.alpha)
            alone[hit] = False
        shorter = left
    count = lambda which: np.bincount(doc[which], minlength=n_docs)
    return n_words, count(unknown), count(alone), np.bincount(doc, scores, minlength=n_docs).astype(float)


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_unknown (words that no other document has), log_score (natural) and log_score_per_word
    of every document."""
    s = settings
    chunked = _chunked(docs, s)
    size = chunked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = _cells(chunked, size // s.bucket + 1, s)
    sums = stage(cells.groupBy("bucket").applyInArrow(_summed, SUMS), "sums", "zstd")
    total = sums.agg(F.sum("words")).first()[0] or 1

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("row"), right.sort_by([("piece", "ascending"), ("n", "ascending"), ("bucket", "ascending")])
        found: dict[int, dict[int, list]] = {}
        for piece, n, packed in zip(*(right.column(c).to_pylist() for c in ("piece", "n", "sums"))):
            found.setdefault(piece, {}).setdefault(n, []).append(packed)
        cuts = np.searchsorted(np.asarray(left.column("row")), list(found)[1:]).tolist()
        parts = []
        for a, b, sums in zip([0, *cuts], [*cuts, left.num_rows], found.values() or [{}]):
            doc, word = _words(left.column("text").slice(a, b - a).combine_chunks())
            parts.append(_scored(doc, word, b - a, {n: np.concatenate([_unpacked(x) for x in p]).view(np.int64) for n, p in sums.items()}, s))
        out = pa.table([left.column("doc_id"), *(pa.array(np.concatenate(c)) for c in zip(*parts))], names=["doc_id", "n_words", "n_unknown", "alone", "base"])
        trimmed()
        return out

    rows = chunked.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(scored, "doc_id long, n_words long, n_unknown long, alone long, base double")
    log_score = F.when(F.col("n_words") > 0, F.col("base") - F.col("alone") * F.lit(float(np.log(total))))
    return rows.select("doc_id", "n_words", "n_unknown", F.round(log_score, 4).alias("log_score"), F.round(log_score / F.col("n_words"), 6).alias("log_score_per_word"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM t),
n AS (SELECT ln(CAST(greatest(count(*), 1) AS DOUBLE)) AS total FROM p),
g AS (SELECT doc_id, i, w AS w3, lag(w, 1) OVER d AS w2, lag(w, 2) OVER d AS w1 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
d1 AS (SELECT doc_id, w3, count(*) AS c FROM g GROUP BY ALL),
d2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
d3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
o1 AS (SELECT doc_id, w3, sum(c) OVER (PARTITION BY w3) - c AS c FROM d1),
o2 AS (SELECT doc_id, w2, w3, sum(c) OVER (PARTITION BY w2, w3) - c AS c FROM d2),
o3 AS (SELECT doc_id, w1, w2, w3, sum(c) OVER (PARTITION BY w1, w2, w3) - c AS c FROM d3),
s AS (
  SELECT g.doc_id, o1.c = 0 AS unknown,
    CASE WHEN o3.c > 0 THEN ln(o3.c) - ln(h2.c)
         WHEN o2.c > 0 THEN ln(o2.c) - ln(h1.c) + (CASE WHEN g.i > 2 THEN ln(0.4) ELSE 0 END)
         ELSE ln(greatest(o1.c, 1)) - total + ln(0.4) * least(g.i - 1, 2) END AS x
  FROM g CROSS JOIN n JOIN o1 ON g.doc_id = o1.doc_id AND g.w3 = o1.w3
    LEFT JOIN o1 h1 ON g.doc_id = h1.doc_id AND g.w2 = h1.w3
    LEFT JOIN o2 ON g.doc_id = o2.doc_id AND g.w2 = o2.w2 AND g.w3 = o2.w3
    LEFT JOIN o2 h2 ON g.doc_id = h2.doc_id AND g.w1 = h2.w2 AND g.w2 = h2.w3
    LEFT JOIN o3 ON g.doc_id = o3.doc_id AND g.w1 = o3.w1 AND g.w2 = o3.w2 AND g.w3 = o3.w3),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (unknown) AS n_unknown, sum(x) AS x FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_unknown, 0) AS BIGINT) AS n_unknown, round(x, 4) AS log_score, round(x / n_words, 6) AS log_score_per_word
FROM t LEFT JOIN a USING (doc_id)
"""
