"""SHA-256 of files of any size, with no task that reads a whole large one.

A digest goes from a file's first byte to its last, so the tasks of a large file follow each other: each takes the state
that the one before left, and reads the next ROUND bytes. Python's hashlib does not give its state away; the library
behind it does. Where that is out of reach, one task hashes what all ranges read.

Ranges are read as lines, which Spark's text reader splits in any store and leaves as bytes; a line must fit into a row.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.sources.staging import stage

#: Bytes of a file that a task hashes, and of the pieces it gets them in.
ROUND, PIECE = 256 << 20, 1 << 20
_STATE = 112


def _library() -> ctypes.CDLL | None:
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        return found if found.SHA256_Init and found.SHA256_Update and found.SHA256_Final else None
    except (ImportError, AttributeError, OSError):
        return None


class Resumable:
    """A digest that goes on from the ``state`` of another."""

    def __init__(self, state: bytes | None = None):
        self._own = _library()
        self._context = ctypes.create_string_buffer(state or b"", 2 * _STATE)
        if state is None:
            self._own.SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        self._own.SHA256_Update(self._context, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self._context.raw[:_STATE]

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._own.SHA256_Final(out, ctypes.create_string_buffer(self.state, 2 * _STATE))
        return out.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, size, block, piece, data) of (file, size, block, value); each line but a file's first has its break before it."""

    def rows(key: tuple, n: int, data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([n], pa.int64()), pa.array([b"".join(data)], pa.binary())], names=["file", "size", "block", "piece", "data"])

    key, n, held, length = None, 0, [], 0
    for batch in batches:
        for *own, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (own := tuple(own)) != key or length >= PIECE:
                if key:
                    yield rows(key, n, held)
                n, held, length = n + 1 if own == key else 0, [], 0
            if own[2] or own == key:
                held.append(b"\n")
            key = own
            held.append(line)
            length += len(line) + 1
    if key:
        yield rows(key, n, held)


def large(spark: SparkSession, paths: list[str], least: int) -> DataFrame:
    """(path, length, sha256) of the files under the paths that have more than ``least`` bytes and are not compressed."""
    text = spark.read.option("lineSep", "\n").text(paths).filter(F.col("_metadata.file_size") > least)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = stage(lines.mapInArrow(_pieces, "file string, size long, block long, piece long, data binary"), "pieces")
    resumed = _library() is not None
    found = pieces.groupBy("file", "size").agg(F.sum(F.length("data")).alias("length"), F.max("block").alias("last")).collect()  # a row a large file
    # the reader leaves out a byte order mark and the last line's break
    out, missing = {r.file: None for r in found}, {r.file: r["size"] - r.length for r in found}
    if wrong := [f for f, n in missing.items() if n not in (0, 1, 3, 4)]:
        raise ValueError(f"not all bytes were read: {wrong}")
    for turn in range(max((r["last"] for r in found), default=-1) // ROUND + 1 if resumed else bool(found)):
        part = pieces.filter(F.col("block").between(turn * ROUND, (turn + 1) * ROUND - 1)) if resumed else pieces

        def run(batches: Iterator[pa.RecordBatch], states: dict = dict(out)) -> Iterator[pa.RecordBatch]:
            digests: dict = {}
            for batch in batches:
                for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if file not in digests:
                        digests[file] = Resumable(states[file]) if resumed else hashlib.sha256()
                        if states[file] is None and missing[file] >= 3:
                            digests[file].update(b"\xef\xbb\xbf")
                    digests[file].update(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(list(digests), pa.string()), pa.array([d.state if resumed else _finished(d, missing[f]) for f, d in digests.items()], pa.binary())], names=["file", "state"])

        ordered = part.select("file", "data", "block", "piece").repartition("file").sortWithinPartitions("file", "block", "piece").select("file", "data")
        out |= {r.file: bytes(r.state) for r in ordered.mapInArrow(run, "file string, state binary").collect()}
    digests = {f: _finished(Resumable(s), missing[f]) if resumed else s for f, s in out.items()}
    return spark.createDataFrame([(r.file, r["size"], digests[r.file].decode()) for r in found], "path string, length long, sha256 string")


def _finished(digest, missing: int) -> bytes:
    if missing in (1, 4):
        digest.update(b"\n")
    return digest.hexdigest().encode()
