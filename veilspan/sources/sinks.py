"""Sinks that leave one copy of a batch, whatever fails or is run again.

An attempt at a batch is written by Spark's own writer into a folder of its own, and counts only once a commit of it stands
beside it. A batch that is committed isn't written again; where two attempts were committed at once, readers take the
same one of them. What a failed attempt has left is never read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch string, attempt string, n long"


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; without one a local session gets a temporary folder, and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or _own_folder()}/veilspan-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="veilspan-")


class BatchSink:
    """Rows of one schema under a root, written batch by batch; each batch has a name."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def commits(self) -> DataFrame:
        """batch, attempt, n (rows) of what is committed: one attempt a batch."""
        try:
            every = self.spark.read.schema(COMMITS).json(f"{self.root}/commits/*")
        except AnalysisException:  # nothing is committed
            return self.spark.createDataFrame([], COMMITS)
        return every.groupBy("batch").agg(F.min_by(F.struct("attempt", "n"), "attempt").alias("x")).select("batch", "x.*")

    def write(self, batch: str, rows: DataFrame) -> bool:
        """Writes and commits a batch; False if it is committed already. An error leaves no commit."""
        if self.commits().where(F.col("batch") == batch).take(1):
            return False
        attempt = uuid.uuid4().hex
        at = f"{self.root}/data/batch={batch}/attempt={attempt}"
        rows.select(*[f.name for f in self._fields()]).write.parquet(at)
        n = self.spark.read.schema(self.schema).parquet(at).count()
        self.spark.createDataFrame([(batch, attempt, n)], COMMITS).coalesce(1).write.json(f"{self.root}/commits/{attempt}")
        return True

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._fields())
        try:
            every = self.spark.read.schema(f"{fields}, batch string, attempt string").parquet(f"{self.root}/data")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return every.join(self.commits().select("batch", "attempt"), ["batch", "attempt"], "left_semi").drop("batch", "attempt")

    def for_stream(self, name: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch takes: a micro-batch that Spark hands over again is written once."""
        return lambda rows, k: self.write(f"{name}-{k}", rows) and None

    def _fields(self):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.schema).fields


EXPORTS = "doc_id long, output_text string, legend array<struct<ord:int,token:string,type:string,occurrences:bigint>>, error string"
BURNT = "doc_id long, page int, png binary"


def export_sink(spark: SparkSession, root: str) -> BatchSink:
    """The sink of rendered texts and legends."""
    return BatchSink(spark, root, EXPORTS)


def page_sink(spark: SparkSession, root: str) -> BatchSink:
    """The sink of burnt pages."""
    return BatchSink(spark, root, BURNT)


def put_exports(sink: BatchSink, batch: str, exports: DataFrame) -> DataFrame:
    """Writes the documents that no gate holds back; returns those it does hold, with what is unresolved."""
    sink.write(batch, exports.where("not gated"))
    return exports.where("gated").select("doc_id", "unresolved")
