"""Token-id files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart from data bytes.

A set of files is a folder with ``ranks`` (the id of each frequency rank, in order) and ``shards``. A shard row holds
one block of whole documents in ascending document order. Its payload, all little-endian:

    4 bytes   magic ``VSI1``
    8 + 8     number of documents, number of values
    8 each    document lengths in values
    ceil(values / 4)   control bytes: two bits a value, low bits first, its number of data bytes less one
    the rest  data bytes: the value's frequency rank in as many bytes as needed, low byte first

Blocks are stored and read through Spark's own writer and reader, so a lost or repeated task leaves no partial file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc, fresh_path, slices, tidy
from .tokens import library_encoder

MAGIC = b"VSI1"
#: A block is closed at so many values.
BLOCK_VALUES = 1_000_000


def control_table() -> np.ndarray:
    """For each control byte the number of data bytes of its four values."""
    byte = np.arange(256)
    return np.stack([(byte >> (2 * k)) & 3 for k in range(4)], axis=1).astype(np.uint8) + np.uint8(1)


CONTROL = control_table()
#: By number of data bytes, the bits of a 32-bit word that belong to the value.
KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_block(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The payload for the values (frequency ranks) of documents of the given lengths."""
    values = np.ascontiguousarray(values, dtype="<u4")
    n, extra = len(values), np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    for limit in (0xFF, 0xFFFF, 0xFFFFFF)[: width - 1]:
        extra[:n] += values > limit
    quads = extra.view("<u4")
    control = (quads | quads >> np.uint32(6) | quads >> np.uint32(12) | quads >> np.uint32(18)).astype(np.uint8)
    starts = np.cumsum(extra[:n], dtype=np.int64) - extra[:n] + np.arange(n)
    low_first, data = values.view(np.uint8).reshape(-1, 4), np.empty(n + int(extra.sum(dtype=np.int64)), dtype=np.uint8)
    data[starts] = low_first[:, 0]
    for k in range(1, width):
        more = np.flatnonzero(extra[:n] >= k)
        data[starts[more] + k] = low_first[more, k]
    return MAGIC + struct.pack("<qq", len(lengths), n) + np.asarray(lengths, dtype="<i8").tobytes() + control.tobytes() + data.tobytes()


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, values) of a payload; the control bytes are resolved by table lookup."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    documents, n = struct.unpack_from("<qq", payload, 4)
    lengths = np.frombuffer(payload, dtype="<i8", count=documents, offset=20)
    at = 20 + 8 * documents
    sizes = CONTROL[np.frombuffer(payload, dtype=np.uint8, count=-(-n // 4), offset=at)].ravel()[:n]
    at += -(-n // 4)
    data = payload[at:] + b"\0\0\0"
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    if n and starts[-1] + sizes[-1] != len(data) - 3:
        raise ValueError("a token block is cut short")
    raw = np.frombuffer(data, dtype=np.uint8)
    words = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        words[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return lengths, words & KEPT[sizes]


def _tokenised(documents: DataFrame, tokenizer_path: str, end_id: int, wide: bool) -> DataFrame:
    """Blocks of ids in ascending order of doc_id over shards: shard, block, start in the shard, doc ids, lengths, raw ids."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        end, block, start = end_id.to_bytes(4, "little"), 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "start": [start], "n": [held], "doc_ids": [doc_ids], "lengths": [lengths], "ids": [np.frombuffer(b"".join(ids), dtype="<u4").astype(kind).tobytes()]}, schema=layout)

        for batch in batches:
            for part, texts in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    got = encoder.ids(text) + end
                    doc_ids.append(doc_id)
                    lengths.append(len(got) // 4)
                    ids.append(got)
                    held += len(got) // 4
                    if held >= BLOCK_VALUES:
                        yield closed()
                        block, start = block + 1, start + held
                        doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield closed()

    layout = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
    in_order = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return in_order.mapInArrow(tidy(run), "shard int, block int, start long, n long, doc_ids array<long>, lengths array<long>, ids binary")


def _frequencies(blocks: DataFrame, size: int, wide: bool) -> np.ndarray:
    """How often each id stands in all blocks; one row a task and id is shuffled, one row an id collected."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), dtype=kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = blocks.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encodes all texts, appends ``end_id`` to each, ranks the ids by frequency over all texts and writes the files.

    Texts are range-partitioned by doc_id once; they are tokenised once, into provisional blocks that are kept
    until the frequencies of all ids are known. What is held at once is a block of about a million ids; the ranks
    (one row an id of the vocabulary) and one total a shard come to the driver.

    A null text counts as empty and is written as the end id alone. Null ids stand before all others, rows that share an id in the
    order of their texts, repeated rows each; further columns are ignored; an empty table writes files without documents.
    """
    spark = documents.sparkSession
    size = max(library_encoder(tokenizer_path).library.get_vocab_size(), end_id + 1)
    wide = size > 65536
    raw = f"{path}/raw"
    _tokenised(documents, tokenizer_path, end_id, wide).write.option("compression", "zstd").parquet(raw)
    blocks = spark.read.parquet(raw)
    counts = _frequencies(blocks, size, wide)
    by_rank = np.lexsort((np.arange(size), -counts))
    rank_of = np.empty(size, dtype=np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame([(rank, token) for rank, token in enumerate(by_rank.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    shard_start, at = {}, 0
    for row in sorted(totals, key=lambda r: r["shard"]):
        shard_start[row["shard"]] = at
        at += row["n"]
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
                shard, lengths = one["shard"].as_py(), one["lengths"].values.to_numpy()
                payload = encode_block(rank_of[np.frombuffer(one["ids"].as_buffer(), dtype=kind)], lengths)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([one["block"].as_py()], pa.int32()), pa.array([shard_start[shard] + one["start"].as_py()]), pa.array([one["doc_ids"].as_py()], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["shard", "block", "start", "doc_ids", "payload"])

    blocks.drop("n").mapInArrow(tidy(run), "shard int, block int, start long, doc_ids array<long>, payload binary").write.option("compression", "zstd").parquet(f"{path}/shards")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(raw)
    where.getFileSystem(conf).delete(where, True)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a set of token files: doc_id, start, n_tokens long, ids_crc32 long, ids (as little-endian unsigned 32-bit bytes).

    A row for each that was written, null ids and repeats too; none for files without documents. Without ``with_ids``
    all ids are read and checked in the same way, but the column ``ids`` isn't made.
    """
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(len(ranks), dtype="<u4")
    for row in ranks:
        id_of[row["rank"]] = row["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, payload in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                lengths, values = decode_block(payload.as_py())
                raw = memoryview(id_of[values]).cast("B")
                ends = np.cumsum(lengths)
                ids = [raw[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(first + ends - lengths), pa.array(lengths), pa.array([crc(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return spark.read.parquet(f"{path}/shards").select("start", "doc_ids", "payload").mapInArrow(tidy(run), schema)


def token_file_digest(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token files of all texts and reads them back: ``doc_id, start, n_tokens, ids_crc32`` a row.

    A null text counts as empty: the end id alone. Null ids stand before all others; rows that share an id stand
    together, in the order of their texts; repeated rows are encoded each. Further columns are ignored. An empty
    table gives no rows.
    """
    path = fresh_path(documents.sparkSession, "token-files")
    write_token_files(documents, tokenizer_path, end_id, path)
    return read_token_files(documents.sparkSession, path, with_ids=False)
