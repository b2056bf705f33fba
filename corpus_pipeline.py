"""A corpus pipeline over ``documents``: toxic texts go, near copies go, personal data is taken out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import ngram_jaccard, packing, pii_terms, toxicity
from veilspan.llm.common import fresh_path, table
from veilspan.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half for toxicity, with all their columns.

    A null text is scored as an empty one. Repeated rows and rows of one id are scored each; further columns pass through, whatever
    their names; no documents give none.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of 80 % similarity on five words or more: that with the smallest id.

    Null, empty and blank texts link with nothing and stay, repeated ones too; of repeated rows with words one stays; null ids
    count as larger than any other; ties are settled by hashes. Further columns pass through; no documents give none.
    """
    return ngram_jaccard.without_near_copies(docs, width=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without personal data and terms that disclose it.

    Rows, null texts and further columns stay; repeated rows are treated alike; no documents give none.
    """
    return pii_terms.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens.

    A null text counts as empty and has its end token only; repeated rows and rows of one id are packed each; further columns are
    ignored; no documents give no pieces.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("pii", sanitise), ("packing", pack)]

#: Training, tokenising and the disclosure statistics have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each kept as Parquet in the shared folder; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
