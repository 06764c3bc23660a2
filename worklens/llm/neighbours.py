"""Nearest neighbours by a block matrix join on int8 tiles.

Vectors are quantised to int8 with a scale of their own; the length of what rounding leaves is kept, so
the distance of two quantised vectors differs from the true one by at most the sum of their two
remainders. Candidates and queries are packed into blocks, every query block meets every candidate
block in one tile, and a tile is one matrix product of int8 codes (exact in float32 up to 1040
dimensions, in float64 beyond). Its distances with their bounds leave few survivors: those whose lower
bound does not exceed the k-th smallest upper bound of their query. Survivors are recomputed in double
precision on the original vectors. Each task keeps a heap of k per query over its tiles, and a ranked
window merges the tasks' heaps. The bounds are strict, so nothing is lost: the answer is exact.

The work is (stated queries) x (candidates), in blocks of bounded size; blocks are dealt by row number,
so a vector that many rows share fills no block by itself.

Defined results: vectors that are null, empty, all zero, or that hold null or non-finite components take
no part, nor do rows without an id; vectors are compared with those of their own length only. Rows with the query's own id are its own and no candidates; other
repeated rows each take a rank. A query id on several rows counts once, with its smallest vector in
array order. Ties go to the smaller id. Fewer than k candidates: all of them. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import stage


@dataclass(frozen=True)
class Settings:
    k: int = 10
    every: int = 100
    candidate_block: int = 1024
    query_block: int = 256
    held: int = 50_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))


BLOCK = "ids binary, dim int, codes binary, scales binary, rests binary, vectors binary"


def _packed(number: str):
    """A block of rows as arrays in one row."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        v = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        scale = np.maximum(np.abs(v).max(axis=1) / 127.0, 5e-324)
        codes = np.rint(v / scale[:, None]).astype(np.int8)
        with np.errstate(over="ignore"):
            rest = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))
        return pd.DataFrame({number: [rows[number].iloc[0]], "dim": [v.shape[1]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "scales": [scale.tobytes()], "rests": [rest.tobytes()], "vectors": [v.tobytes()]})[[number, "ids", "dim", "codes", "scales", "rests", "vectors"]]

    return pack


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    shape = (len(ids), row["dim"])
    return ids, np.frombuffer(row[f"{side}_codes"], np.int8).reshape(shape), np.frombuffer(row[f"{side}_scales"]), np.frombuffer(row[f"{side}_rests"]), np.frombuffer(row[f"{side}_vectors"]).reshape(shape)


def distances(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, added up component by component, in order, so that the last bit does not depend on the
    tile. Where squares would overflow or vanish, the components are scaled by a power of two."""
    with np.errstate(over="ignore", under="ignore"):
        d = c - q
        top = np.abs(d).max(axis=1)
        power = np.where((top > 1e150) & np.isfinite(top) | (top > 0) & (top < 1e-120), np.frexp(top)[1], 0)
        if not power.any():
            return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
        d = np.ldexp(d, -power[:, None])
        return np.ldexp(np.sqrt(np.cumsum(d * d, axis=1)[:, -1]), power)


def tile(queries: tuple, candidates: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, exact distances) of every candidate that may be among a query's k nearest here."""
    q_ids, q_codes, q_scale, q_rest, q = queries
    c_ids, c_codes, c_scale, c_rest, c = candidates
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qf, cf = q_codes.astype(exact), c_codes.astype(exact)
    product = (qf @ cf.T).astype(np.float64)
    # huge components make bounds that are not finite; those pairs are all computed in full
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        low, high = _bounds(product, qf, cf, q_scale, c_scale, q_rest, c_rest)
    own = q_ids[:, None] == c_ids[None, :]
    high[own] = low[own] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(q_ids), np.inf)
    for i in range(len(q_ids)):
        left = np.flatnonzero((low[i] <= limit[i]) & ~own[i])
        if len(left):
            yield int(q_ids[i]), c_ids[left], distances(c[left], q[i])


def _bounds(product, qf, cf, q_scale, c_scale, q_rest, c_rest) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest distance that a pair may have."""
    q_norm, c_norm = (qf.astype(np.float64) ** 2).sum(axis=1) * q_scale**2, (cf.astype(np.float64) ** 2).sum(axis=1) * c_scale**2
    squared = q_norm[:, None] + c_norm[None, :] - 2.0 * product * q_scale[:, None] * c_scale[None, :]
    near = np.sqrt(np.maximum(squared, 0.0))
    # the bound of quantisation, widened by what cancellation may have cost the square root
    slack = (q_rest[:, None] + c_rest[None, :]) * (1 + 1e-9) + 1e-7 * np.sqrt(q_norm[:, None] + c_norm[None, :])
    fine = np.isfinite(near) & np.isfinite(slack)
    return np.where(fine, near - slack, -np.inf), np.where(fine, near + slack, np.inf)


def search(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance): the k nearest rows of every row whose
    vec_id is divisible by ``every``."""
    s = settings
    rows = stage(usable(vectors).withColumn("number", F.monotonically_increasing_id()), "vectors")
    # row numbers count on from each partition's own start, so blocks are (partition, run of rows)
    block = F.concat_ws("/", F.size("embedding"), F.shiftright("number", 33), F.floor(F.col("number").bitwiseAND((1 << 33) - 1) / s.candidate_block))
    candidates = rows.withColumn("block", block).groupBy("block").applyInPandas(_packed("block"), f"block string, {BLOCK}")
    candidates = stage(candidates, "candidate-blocks")
    asked = rows.filter(F.col("vec_id") % s.every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = max(1, -(-asked.count() // s.query_block))
    asked = asked.withColumn("part", F.concat_ws("/", F.size("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(n))))
    asked = stage(asked.groupBy("part").applyInPandas(_packed("part"), f"part string, {BLOCK}"), "query-blocks")
    # the tiles: every pair of a query block and a candidate block of the same length of vectors
    grid = asked.select("part", "dim").join(candidates.select("block", "dim"), "dim").select("part", "block")
    fields = ("ids", "codes", "scales", "rests", "vectors")
    left = asked.drop("dim").withColumnsRenamed({f: f"q_{f}" for f in fields})
    right = candidates.withColumnsRenamed({f: f"c_{f}" for f in fields})
    tiles = grid.join(left, "part").join(right, "block").select("dim", *(f"{side}_{f}" for side in "qc" for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}

        def flushed() -> pa.RecordBatch:
            found = [(q, -i, -d) for q, heap in heaps.items() for d, i in heap]
            heaps.clear()
            cols = list(zip(*found)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                for query, ids, distances in tile(_unpacked(row, "q"), _unpacked(row, "c"), s.k):
                    heap = heaps.setdefault(query, [])
                    for entry in zip((-distances).tolist(), (-ids).tolist()):
                        if len(heap) < s.k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                if len(heaps) > s.held:
                    yield flushed()
        yield flushed()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
