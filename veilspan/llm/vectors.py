"""Chunks of usable vectors: blocks of bounded size that pairs of tasks can work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy


def usable(batch: pa.RecordBatch, vec_at: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors that are neither null nor zero and hold only finite components.

    Vectors of another length than the first usable one raise, as they can't be compared.
    """
    rows, kept, width = [], [], None
    for k, v in enumerate(batch.column(vec_at).to_pylist()):
        if not v or None in v:
            continue
        x = np.array(v, dtype=np.float64)
        if not np.isfinite(x).all() or not x.any():
            continue
        if width is not None and len(x) != width:
            raise ValueError(f"vectors of {width} and of {len(x)} components")
        width = len(x)
        rows.append(k)
        kept.append(x)
    return np.array(rows, dtype=np.int64), np.array(kept).reshape(len(kept), width or 0)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows times powers of two that bring their largest components near 1, and the exponents taken out.

    Squares of what remains neither over- nor underflow, and no digit is lost.
    """
    exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    return np.ldexp(vectors, -exponent[:, None]), exponent


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows' directions."""
    own, _ = scaled(vectors)
    return own / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]


def chunked(embeddings: DataFrame, chunks: int, mark: str | None = None) -> DataFrame:
    """A row for each part of a chunk: chunk, keys, ids, vectors (as bytes), and marks, if a column of booleans is named.

    Rows are dealt out in turn, so all chunks are of one size whatever the ids are. A key names a row: the task's
    number and the row's place in the task. Null ids are left out of ``ids`` by the value -2**63.
    """
    names = ["chunk", "keys", "ids", "vectors", *(["marks"] if mark else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, vectors = usable(batch, 1)
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)[rows]
            keys = (np.int64(task) << np.int64(33)) + at + rows
            marks = [batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)[rows].astype(np.uint8)] if mark else []
            lot = (task + at + np.arange(len(rows))) % chunks
            at += batch.num_rows
            for c in np.unique(lot).tolist():
                own = lot == c
                parts = [keys[own], ids[own].astype("<i8"), vectors[own].astype("<f8"), *(m[own] for m in marks)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *([F.col(f"`{mark}`")] if mark else [])]
    return embeddings.select(*columns).mapInArrow(tidy(run), "chunk int, " + ", ".join(f"{n} binary" for n in names[1:]))


def joined_parts(parts: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, matrix) of a chunk's parts, in order of their keys."""
    keys = np.frombuffer(b"".join(p[0] for p in parts), dtype="<i8")
    ids = np.frombuffer(b"".join(p[1] for p in parts), dtype="<i8")
    vectors = np.frombuffer(b"".join(p[2] for p in parts), dtype="<f8").reshape(len(keys), -1)
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order], vectors[order]
