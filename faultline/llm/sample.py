"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import tidied

#: Labelled documents a classifier is fitted on, at most.
SAMPLE_DOCS = 6000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, usable: Column, features: Callable[[pa.Array], list[bytes]], limit: int = SAMPLE_DOCS) -> tuple[np.ndarray, list[bytes]]:
    """Labels (0 or 1) and packed features of at most ``limit`` usable labelled documents.

    The ids that come first by hash are taken; the sample is the same in every run. Only ids,
    labels and features reach the driver, never texts.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``limit``

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(features(batch.column(2).cast(pa.string())), pa.binary())], names=["doc_id", "label", "features"])

    table = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features binary").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("features", "ascending")])
    return table.column("label").to_numpy(), table.column("features").to_pylist()


def adam(params: list[np.ndarray], gradient: Callable[[list[np.ndarray]], list[np.ndarray]], steps: int, rate: float) -> list[np.ndarray]:
    """Plain Adam over full batches."""
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(params), m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return params


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
