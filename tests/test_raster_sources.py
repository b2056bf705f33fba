import io
import json
import zlib

import numpy as np
import pytest

from veilspan.functions.contract import SpanError
from veilspan.operators import raster
from veilspan.operators.patterns import detect_patterns
from veilspan.sources import models, texts
from veilspan.streaming.stream import decision_stream, pattern_stream, windowed_counts


def test_page_kinds(spark):
    pages = spark.createDataFrame([(1, 0, "  short  "), (1, 1, "long enough text"), (1, 2, None)], "doc_id long, page int, text string")
    assert [tuple(r)[1:] for r in raster.page_kinds(pages).orderBy("page").collect()] == [(0, "raster", 5), (1, "digital", 16), (2, "raster", 0)]
    assert {(r["kind"], r["extractable_chars"]) for r in raster.page_kinds(pages, force_ocr=True).collect()} == {("raster", 0)}


def test_words_to_boxes_to_pixels(spark):
    image = np.full((40, 200, 3), 255, dtype=np.uint8)
    seen = [("Call", 90, 1, 1, 1, 5, 5, 30, 10), ("0413", 80, 1, 1, 1, 40, 5, 30, 10), ("552", 80, 1, 1, 1, 75, 5, 20, 10), ("", 90, 1, 1, 1, 0, 0, 1, 1), ("760", 70, 1, 1, 1, 100, 5, 20, 10), ("now", 60, 1, 1, 2, 5, 20, 20, 10)]
    images = spark.createDataFrame([(1, 0, 200, 40, bytearray(image.tobytes()))], "doc_id long, page int, width int, height int, rgb binary")
    placed = raster.placed_words(raster.recognised_words(images, lambda rgb, w, h: seen)).cache()
    pages = raster.page_texts(placed)
    assert pages.first()["text"] == "Call 0413 552 760\nnow"
    found = detect_patterns(pages).join(pages.select("doc_id", "page"), "doc_id")
    boxes = raster.span_boxes(found, placed)
    assert sorted(r["box"]["x0"] for r in boxes.collect()) == [40, 75, 100]
    data = raster.burnt_pages(images, boxes).first()["png"]
    rows = np.frombuffer(zlib.decompress(bytes(data)[bytes(data).index(b"IDAT") + 4 : -16]), dtype=np.uint8).reshape(40, 601)[:, 1:].reshape(40, 200, 3)
    assert rows[4:16, 39:71].max() == 0 and rows[4:16, 5:35].min() == 255 and rows[30:].min() == 255


def test_burning_is_clamped():
    out = raster.burnt(np.full((5, 5, 3), 9, dtype=np.uint8), [(-3, -3, 0, 0), (4, 4, 50, 50)])
    assert out[0, 0].max() == 0 and out[1, 1].max() == 0 and out[4, 4].max() == 0 and out[2, 2].min() == 9


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é one\ntwo", encoding="utf-8")
    assert [r["text"] for r in texts.files(spark, f"{tmp_path}/*.txt").collect()] == ["é one\ntwo"]
    (tmp_path / "r.json").write_text(json.dumps({"doc_id": 1, "text": "x", "output_mode": "REDACT"}) + "\n" + json.dumps({"doc_id": 2, "text": ""}))
    assert texts.json_documents(spark, f"{tmp_path}/r.json").count() == 1
    texts.inline(spark, ["a", "b"]).write.parquet(f"{tmp_path}/t")
    assert texts.table(spark, f"{tmp_path}/t").count() == 2
    with pytest.raises(ValueError):
        texts.inline(spark, [""])
    gated = spark.createDataFrame([(1, False, "x", None), (2, True, None, "u")], "doc_id long, gated boolean, output_text string, unresolved string")
    assert texts.write_open_exports(gated, f"{tmp_path}/out").count() == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("from input"))
    assert texts.argument(spark, "-").first()["text"] == "from input" and texts.argument(spark, "arg").first()["text"] == "arg"


def test_pdf_seam(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    pages = texts.pdf_pages(spark, f"{tmp_path}/a.pdf", lambda content, dpi: [(0, content.decode(), 1, 1, b"\0\0\0")])
    assert pages.first()["text"] == "%PDF"


def test_model_clients():
    sent = []

    def hosted(url, headers, body, timeout):
        sent.append((url, json.loads(body)))
        return json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}]}).encode()

    settings = models.Settings.from_environment({"VEILSPAN_HOSTED_MODEL": "m", "VEILSPAN_ORIGINS": "a, b"})
    assert settings.origins == ("a", "b")
    assert models.make_client(settings, transport=hosted).complete(system="s", user="u") == "ab" and sent[0][1]["max_tokens"] == 1024 and sent[0][1]["model"] == "m"
    local = models.make_client(settings, "local", lambda *a: json.dumps({"message": {"content": "c"}}).encode())
    assert local.complete(system="s", user="u") == "c"

    def down(*a):
        raise OSError

    for name, transport, status in (("gemma_local", down, 502), ("nothing", down, 500)):
        with pytest.raises(SpanError) as e:
            models.make_client(settings, name, transport).complete(system="s", user="u")
        assert e.value.status == status


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.org and c@d.org", "2024-01-01 00:01:00"), (2, "none", "2024-01-01 00:02:00")], "doc_id long, text string, ts string").selectExpr("doc_id", "text", "timestamp(ts) ts").write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(f"{tmp_path}/docs")
    q = pattern_stream(stream).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 2
    timed = stream.selectExpr("doc_id", "ts", "explode(split(text, ' ')) type")
    q = windowed_counts(timed, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").count() == 4
    log = [(1, 1, "accept", "a"), (1, 2, "dismiss", "a"), (1, 3, "undo", None), (1, 4, "accept", "b"), (2, 1, "undo", None), (2, 2, "dismiss", "c"), (2, 3, "undo", None)]
    spark.createDataFrame(log, "doc_id long, seq long, type string, target_id string").coalesce(1).write.parquet(f"{tmp_path}/log")
    actions = spark.readStream.schema("doc_id long, seq long, type string, target_id string").parquet(f"{tmp_path}/log")
    q = decision_stream(actions).writeStream.format("memory").queryName("decided").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["doc_id"], r["target_id"], r["status"]) for r in spark.table("decided").collect()} == {(1, "a", "accepted"), (1, "b", "accepted"), (2, "c", "pending")}
