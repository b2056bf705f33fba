"""A table of a model's replies: what was asked once isn't asked again, whatever document it stands in.

A question is named by a digest of the system prompt and the passage. Runs ask only for names the table lacks, each once
however many windows share it; calls that fail leave no reply, so the next run asks them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model_layer import DETECT_PROMPT, asked
from ..sources.sinks import BatchSink

REPLIES = "key string, reply string"


def reply_table(spark, root: str) -> BatchSink:
    """The table of replies under a root."""
    return BatchSink(spark, root, REPLIES)


def keyed(windows: DataFrame, prompt: str = DETECT_PROMPT) -> DataFrame:
    """Windows with ``key``, the name of what the model is asked about them."""
    return windows.withColumn("key", F.sha2(F.concat(F.lit(prompt + "\0"), "chunk"), 256))


def answered(windows: DataFrame, client, table: BatchSink) -> DataFrame:
    """doc_id, w_start, chunk, reply, failure of all windows; what the table lacked is asked and kept first.

    A reply may come for a window whose key another run has answered meanwhile; the one that reads first in order counts.
    """
    own = keyed(windows)
    known = table.read().select("key").distinct()
    new = own.groupBy("key").agg(F.first("chunk").alias("chunk")).join(known, "key", "left_anti")
    replies = asked(new.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("w_start"), "chunk"), client)
    table.write(uuid.uuid4().hex, keyed(replies.where("failure is null")))
    kept = table.read().groupBy("key").agg(F.min("reply").alias("reply"))
    failed = F.when(F.col("reply").isNull(), "unanswered")
    return own.join(kept, "key", "left").select("doc_id", "w_start", "chunk", "reply", failed.alias("failure"))
