"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are lower-cased runs of letters and digits, and runs of one same punctuation mark; a token that
repeats its predecessor becomes a repeat mark, so that a looped word looks alike whatever the word is.
Unigrams and bigrams are hashed into ``2 ** bits`` coordinates. A document is the L2-normalised vector
of its damped n-gram counts, and its score is the sigmoid of a sparse dot product with the weights.

Training reads at most ``max_rows`` labelled rows (those with the smallest hash of their doc_id; the
bound is this documented parameter). They are dealt to ``shards`` groups; each group runs ``epochs``
passes of per-example follow-the-regularised-leader updates, and the models are averaged. Scoring covers
every document in full. The weights have a fixed size, so broadcasting them is bounded by ``bits``.

Defined results: null or empty texts score as the bias alone; null doc_id: not learned from, scored;
several labels of one doc_id: all are used; no usable labels, or labels of one class only: the weights
stay at the prior of what was seen (0.5 without labels); repeated rows are scored row by row; other
columns are ignored by :func:`score` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import flat
from worklens.llm.common import text_batches, tidied

HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"
_LETTERS = flat.word_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
_MARKS = flat.word_table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_rows: int = 16_000
    shards: int = 4
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, coordinate, value) of a run of documents, sorted by document; values L2-normalised."""
    w = flat.words(raw, offsets, _LETTERS, _MARKS)
    h = w.hash.copy()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    h[same] = _REPEAT
    two = w.doc[1:] == w.doc[:-1]
    doc = np.concatenate([w.doc, w.doc[1:][two]])
    slot = np.concatenate([h, flat.joined(h[:-1][two], h[1:][two])]) >> np.uint64(64 - bits)
    key = (doc.astype(np.int64) << bits) | slot.astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc = key >> bits
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(offsets) - 1))
    return doc, key & ((1 << bits) - 1), value / norm[doc]


def _trained(texts: pa.Array, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights (the bias last) of one shard."""
    width = (1 << s.bits) + 1
    z, n = np.zeros(width), np.zeros(width)
    examples = []
    for a, _, raw, offsets in flat.runs(texts):
        doc, slot, value = features(raw, offsets, s.bits)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        examples += [(a + i, np.append(slot[cut[i] : cut[i + 1]], width - 1), np.append(value[cut[i] : cut[i + 1]], 1.0)) for i in range(len(offsets) - 1)]

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for e in order.permutation(len(examples)):
            i, at, x = examples[e]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, float(w @ x)))))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(width))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The averaged weights, ``2 ** bits`` and a bias, from labelled rows outside the held-out fold."""
    known = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) quality").filter(f"doc_id is not null and quality in (0, 1) and not ({HELD_OUT})")
    order = F.xxhash64("doc_id")
    picked = known.orderBy(order, "doc_id", "quality").limit(settings.max_rows)
    shards = (
        docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
        .join(F.broadcast(picked), "doc_id")  # at most max_rows rows
        .select(F.pmod(order, F.lit(settings.shards)).alias("shard"), "doc_id", "text", "quality")
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "quality"], kind="stable")
        w = _trained(pa.array(rows["text"].tolist(), pa.string()), rows["quality"].to_numpy(float), settings)
        at = np.flatnonzero(w)
        return pd.DataFrame({"n": [len(rows)], "at": [at.astype(np.int32).tobytes()], "w": [w[at].astype(np.float32).tobytes()]})

    total, seen = np.zeros((1 << settings.bits) + 1), 0
    for r in shards.groupBy("shard").applyInPandas(fit, "n long, at binary, w binary").collect():  # shards rows of bounded size
        total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["w"], np.float32) * float(r["n"])
        seen += r["n"]
    return (total / max(seen, 1)).astype(np.float32)


def _scorer(weights: np.ndarray, bits: int):
    def scores(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, raw, offsets in flat.runs(texts):
            doc, slot, value = features(raw, offsets, bits)
            out[a:b] = np.bincount(doc, weights[slot] * value, minlength=b - a)
        return 1.0 / (1.0 + np.exp(-(out + float(weights[-1]))))

    return scores


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, settings.bits)
        for batch in batches:
            got = scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", f"coalesce({HELD_OUT}, false) held_out", "cast(text as string) text").mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, settings.bits)
        for batch in batches:
            good = pa.array(scores(batch.column(at).cast(pa.string())) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns], names=batch.schema.names)

    return text_batches(docs).mapInArrow(tidied(run), docs.schema)
