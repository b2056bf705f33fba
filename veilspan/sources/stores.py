"""Tables kept under a name: the store of sessions and of reviews."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.contract import SpanError


class TableStore:
    """Parquet tables in a folder for each name, written and read by Spark alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str, table: str) -> str:
        if not name.isalnum():
            raise SpanError(404, "session_not_found", f"no session {name!r}")
        return f"{self.root}/{name}/{table}"

    def put(self, name: str, **tables: DataFrame) -> None:
        for table, frame in tables.items():
            frame.write.mode("overwrite").parquet(self._path(name, table))

    def append(self, name: str, **tables: DataFrame) -> None:
        for table, frame in tables.items():
            frame.write.mode("append").parquet(self._path(name, table))

    def has(self, name: str, table: str) -> bool:
        try:
            self.spark.read.parquet(self._path(name, table))
        except (AnalysisException, SpanError):
            return False
        return True

    def get(self, name: str, table: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self._path(name, table))
        except AnalysisException as error:
            raise SpanError(404, "session_not_found", f"no session {name!r}") from error
