"""Helpers the operators of this subpackage share: the staging folder and checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.sources.staging import shared_dir, stage

__all__ = ["broadcast_if", "shared_dir", "stage", "text_batches", "tidied", "trimmed", "unused"]


#: Rows that Spark hands to a Python worker at once; texts are long, so the default of 10,000 fills memory.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session handing texts to Python workers in batches of BATCH_ROWS at most."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def trimmed() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later groups and stages, where what they
    hold would count against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint when the counted ``rows`` are within ``limit``; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df
