"""Packing of documents into training sequences by first-fit decreasing with a tournament tree.

Documents are cut at multiples of the sequence length; what remains of each is packed. The tree's leaves are the
room left in the bins and each inner node is the larger of its two, so the first bin with enough room is found in
one descent. Packing runs independently in groups of documents that a seeded hash deals out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, slices, tidy
from .tokens import library_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; larger items go first, ties in their given order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return bins, offsets
    if sizes.max() > capacity:
        raise ValueError("an item is larger than a bin")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def pieces(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of each document's ids (with ``end_id``), cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            for part, texts in slices(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    raw = encoder.ids(text) + end
                    n = len(raw) // 4
                    rows += [(doc_id, at, min(capacity, n - at), crc(raw[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), PIECES)


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group_documents: int = 1024, seed: int = 17) -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Only these
    few numbers a piece are shuffled, into about one group for every ``group_documents`` documents. Whole-length
    pieces of long documents are dealt over all groups, so no document fills a group. A null text counts as empty:
    one piece with the end id alone. Rows with null or equal ids are packed as documents of their own. Further
    columns are ignored; an empty table gives no rows.
    """
    groups = max(1, -(-documents.count() // group_documents))
    dealt = F.when(F.col("length") == capacity, F.xxhash64("doc_id", "start", F.lit(seed))).otherwise(F.xxhash64("doc_id", "ids_crc32", F.lit(seed)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32", "length", "doc_tokens"], kind="stable", na_position="first", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        return group.drop(columns="bucket").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return pieces(documents, tokenizer_path, end_id, capacity).withColumn("bucket", F.pmod(dealt, F.lit(groups))).groupBy("bucket").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
