"""Sinks that leave one copy, and replies that are asked for once."""

import pytest
from pyspark.sql import functions as F

from veilspan.operators import model_layer
from veilspan.plans import replies
from veilspan.sources import sinks


def test_batches_are_written_once(spark, tmp_path):
    sink = sinks.BatchSink(spark, f"file://{tmp_path}/out", "k long, v string")
    assert sink.read().count() == 0 and sink.read().columns == ["k", "v"]
    rows = spark.createDataFrame([(1, "a", 9), (2, None, 9), (2, None, 9)], "k long, v string, more int")
    assert sink.write("one", rows) and not sink.write("one", rows) and sink.write("two", rows.limit(0))
    assert sorted(map(tuple, sink.read().collect()), key=repr) == [(1, "a"), (2, None), (2, None)]
    assert {(r["batch"], r["n"]) for r in sink.commits().collect()} == {("one", 3), ("two", 0)}


def test_a_failed_task_leaves_nothing_and_a_rerun_one_copy(spark, tmp_path):
    sink = sinks.BatchSink(spark, f"file://{tmp_path}/out", "k long")
    fails = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        sink.write("b", fails)
    assert sink.read().count() == 0
    assert sink.write("b", spark.range(100).withColumnRenamed("id", "k"))
    assert sink.read().count() == 100
    # Another attempt at the batch, committed at the same time by another driver: readers agree on one of them.
    twin = f"{tmp_path}/out/data/batch=b/attempt=0"
    spark.range(5).withColumnRenamed("id", "k").write.parquet(f"file://{twin}")
    assert sink.read().count() == 100
    spark.createDataFrame([("b", "0", 5)], sinks.COMMITS).coalesce(1).write.json(f"file://{tmp_path}/out/commits/0")
    assert sink.read().count() == 5


def test_a_stream_that_starts_anew_leaves_one_copy(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    sink = sinks.BatchSink(spark, f"file://{tmp_path}/out", "id long")
    for _ in range(2):  # the second run has no checkpoint of the first
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(sink.for_stream("s")).start()
        q.processAllAvailable()
        q.stop()
    assert sink.read().count() == 20


def test_exports_and_pages(spark, tmp_path):
    exports = spark.createDataFrame([(1, False, "text", [(1, "[ORG_1]", "ORG", 2)], None, None), (2, True, None, None, [(0, 1, "m:0-1")], None)], "doc_id long, gated boolean, output_text string, legend array<struct<ord:int,token:string,type:string,occurrences:bigint>>, unresolved array<struct<start:int,end:int,id:string>>, error string")
    sink = sinks.export_sink(spark, f"file://{tmp_path}/exports")
    for _ in range(2):
        assert [r["doc_id"] for r in sinks.put_exports(sink, "x", exports).collect()] == [2]
    assert [(r["doc_id"], r["legend"][0]["token"]) for r in sink.read().collect()] == [(1, "[ORG_1]")]
    pages = sinks.page_sink(spark, f"file://{tmp_path}/pages")
    pages.write("p", spark.createDataFrame([(1, 0, b"\x89PNG")], sinks.BURNT))
    assert bytes(pages.read().first()["png"]) == b"\x89PNG"


class Noting:
    """Answers with the passage's first word, notes each call in a folder, and fails on passages with a given word."""

    def __init__(self, folder, bad=None):
        self.folder, self.bad = folder, bad

    def complete(self, *, system, user):
        import uuid

        passage = user.split("\n\n", 1)[1]
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(passage)
        if self.bad and self.bad in passage:
            raise RuntimeError("down")
        return '{"entities": [{"text": "' + passage.split()[0] + '", "type": "PERSON"}]}'


def test_replies_are_asked_for_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = replies.reply_table(spark, f"file://{tmp_path}/replies")
    docs = spark.createDataFrame([(1, "Ann met her doctor"), (2, "Ann met her doctor"), (3, "Bo saw a nurse"), (4, "nothing")], "doc_id long, text string")
    windows = model_layer.gated(model_layer.text_windows(docs))
    first = replies.answered(windows, Noting(str(calls), "nurse"), table).cache()
    assert {(r["doc_id"], r["failure"]) for r in first.collect()} == {(1, None), (2, None), (3, "unanswered")} and len(list(calls.iterdir())) == 2
    more = model_layer.gated(model_layer.text_windows(docs.union(spark.createDataFrame([(5, "Cy pays a claim")], "doc_id long, text string"))))
    again = replies.answered(more, Noting(str(calls)), table)
    hits = model_layer.detect_with_model(docs, replies=again)
    assert sorted((r["doc_id"], r["text"]) for r in hits.collect()) == [(1, "Ann"), (2, "Ann"), (3, "Bo"), (5, "Cy")]
    assert len(list(calls.iterdir())) == 4
    replies.answered(more, Noting(str(calls)), table).collect()
    assert len(list(calls.iterdir())) == 4
    assert model_layer.detect_with_model(docs, replies=first.where("doc_id = 3")).count() == 0
