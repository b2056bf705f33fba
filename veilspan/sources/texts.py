"""Sources of documents and sinks of results."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf


def inline(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """doc_id (from 0) and text; an empty text is refused."""
    if any(not t for t in texts):
        raise ValueError("a text must have at least one character")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def argument(spark: SparkSession, value: str) -> DataFrame:
    """A command-line text, or standard input for ``-``."""
    return inline(spark, [sys.stdin.read() if value == "-" else value])


def files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each UTF-8 file: doc_id (a hash of the path), path, text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def table(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and text of a Parquet table; other columns aren't read."""
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines {doc_id, text, output_mode}."""
    return spark.read.schema("doc_id long, text string, output_mode string").json(path).where(F.length("text") >= 1)


def pdf_pages(spark: SparkSession, path: str, reader: Callable[[bytes, int], Sequence[tuple]] | None = None, dpi: int = 200) -> DataFrame:
    """Pages of PDF files: doc_id, page, text, width, height, rgb. ``reader`` is a function (file bytes, dpi) -> rows of all but the
    first; without one the package's own parser reads them (``sources.pdf``), and rows of unreadable files are left out."""
    if reader is None:
        return pdf.pdf_pages(spark, path).where("error is null").select("doc_id", "page", "text", "width", "height", "rgb")
    blobs = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *page) for d, content in zip(batch["doc_id"], batch["content"], strict=True) for page in reader(content, dpi)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "width", "height", "rgb"])

    return blobs.mapInPandas(run, "doc_id long, page int, text string, width int, height int, rgb binary")


def write_exports(exports: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes rendered texts and legends as Parquet or JSON."""
    exports.write.mode("overwrite").format(kind).save(path)


def write_open_exports(exports: DataFrame, path: str) -> DataFrame:
    """Writes the documents that no gate holds back; returns those it does hold, with what is unresolved."""
    write_exports(exports.where("not gated").drop("unresolved", "gated"), path)
    return exports.where("gated").select("doc_id", "unresolved")
