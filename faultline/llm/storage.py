"""Files that driver and executors share.

Artefacts go below ``spark.checkpoint.dir`` (see ``plans.iterate``). Tasks write under names that hold
their attempt, and only names a successful task returned are ever read, so a lost executor or a
speculative copy leaves no trace in a result.
"""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut as materialize
from ..plans.iterate import discard, shared_folder

__all__ = ["BROADCAST_ROWS", "attempt_name", "discard", "few", "keyed", "materialize", "open_input", "open_output", "shared_folder", "tidied", "tidy", "without"]

#: Rows of ids and numbers that may be broadcast (about 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def few(written: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if a count shows that it is small enough."""
    return F.broadcast(written) if written.count() <= limit else written


def without(docs: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is among ``gone``'s only column (null equals null)."""
    gone = materialize(gone.toDF("__gone").distinct(), name)
    return docs.join(few(gone), docs[key].eqNullSafe(gone["__gone"]), "left_anti")


def tidy() -> None:
    """Give memory that this worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidied(function):
    """A function of batches that leaves a tidy worker behind."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def open_output(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def attempt_name(folder: str, suffix: str) -> tuple[int, str]:
    """This task's partition and a file name no other attempt uses."""
    ctx = TaskContext.get()
    return ctx.partitionId(), f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}{suffix}"


def keyed(docs: DataFrame, name: str = "keyed") -> tuple[DataFrame, bool]:
    """``docs`` with a column ``__key`` that tells rows apart and is the same in every evaluation.

    Where doc_id is unique and never null it serves (and the second value is true); otherwise rows
    are numbered in a written copy.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.withColumn("__key", F.col("doc_id").cast("long")), True
    return materialize(docs.withColumn("__key", F.monotonically_increasing_id()), name), False
