"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken from an Arrow batch in slices of at most so many rows or characters.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where the session names none, a local session takes a temporary folder; on a cluster that is an error, as the
    executors would write to folders the others can't see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="veilspan-")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Bytes of rows sent to a Python task at once, in sessions that set no bound of their own.
BATCH_BYTES = 4 << 20


def _bound_batches() -> None:
    """Sets the session's bound on the bytes of a batch, unless it has one: 10,000 rows of any length aren't bounded,
    and each task holds several copies of a batch, some of them outside the heap."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """A task function that gives its freed memory back at the end; its batches are bounded in bytes.

    Python workers are kept for later tasks, so what their allocators hold would stand beside all later stages.
    """
    _bound_batches()

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: A group of more rows than this, and than one in HOT_SHARE of all rows, is looked up by a broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 10_000


def join_labels(rows: DataFrame, labels: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``labels`` (one row a ``key``, without ``size``), null where there is no label.

    ``size`` says how many of the ``total`` rows a label is for. Labels of large groups are broadcast, of which there
    can be at most HOT_SHARE, so no task gets a whole large group; all others are joined by a shuffle.
    """
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(labels.where(F.col(size) > bound).drop(size))
    cold = labels.where(F.col(size) <= bound).drop(size)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(col: Column | str) -> Column:
    """CRC32 of a document id as text; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts as Python strings (null: empty), of bounded size."""
    at = batch.schema.get_field_index(text)
    for low in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(low, SLICE_ROWS)
        texts = [x or "" for x in part.column(at).to_pylist()]
        begin = size = 0
        for k, x in enumerate(texts):
            if size and size + len(x) > SLICE_CHARS:
                yield part.slice(begin, k - begin), texts[begin:k]
                begin, size = k, 0
            size += len(x)
        if texts:
            yield part.slice(begin), texts[begin:]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, object]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One output row per row: the columns ``keep`` and those ``fn`` makes of each slice's texts.

    ``schema`` lists all columns in order. Only ``keep`` and ``text`` are read.
    """
    out_schema = df.select(*keep).schema
    for field in _parsed(schema):
        if field.name not in keep:
            out_schema = out_schema.add(field)
    names = [f.name for f in out_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                made = fn(texts)
                columns = [part.column(part.schema.get_field_index(n)) if n in keep else pa.array(made[n]) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*keep, text).mapInArrow(tidy(run), out_schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)
