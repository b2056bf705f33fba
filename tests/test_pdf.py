"""Pages of PDF files that are built here."""

import json
import zlib

import numpy as np
import pytest

from veilspan.functions.contract import SpanError
from veilspan.operators import patterns, raster
from veilspan.sources import models, pdf, texts

PHONE = "0413 552 760"


def built(objects: dict[int, bytes], root: int = 1) -> bytes:
    out, places = b"%PDF-1.5\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer << /Root %d 0 R /Size %d >>\nstartxref\n0\n%%%%EOF" % (root, len(objects) + 1)


def stream(data: bytes, more: bytes = b"", deflate: bool = True, length: bytes | None = None) -> bytes:
    raw = zlib.compress(data) if deflate else data
    return b"<< /Length %s %s %s >>\nstream\n%s\nendstream" % (length or b"%d" % len(raw), b"/Filter /FlateDecode" if deflate else b"", more, raw)


def digital(content: bytes, **how) -> bytes:
    return built({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: stream(content, **how), 5: b"<< /Type /Font /BaseFont /Helvetica >>", 6: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 7 0 R] >>", 7: stream(b"BT /F1 9 Tf (more) Tj ET", deflate=False),
    })


LINES = rb"BT /F1 12 Tf 72 720 Td (Claimant \(phone\) " + PHONE.encode() + rb" on file.) Tj 0 -14 Td [(Sec) -20 (ond) -400 (l\351ne\041)] TJ T* <4869> Tj 1 0 0 1 72 600 Tm (far) Tj % a (comment" + b"\n(down) ' ET"
TEXT = f"Claimant (phone) {PHONE} on file.\nSecond léne!\nHi\nfar\ndown"


def scanned(pixels: np.ndarray, more: bytes = b"", data: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    colour = b"/DeviceRGB" if pixels.ndim == 3 else b"/DeviceGray"
    image = stream(pixels.tobytes() if data is None else data, b"/Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s %s" % (width, height, colour, more))
    return built({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R >> >> >>", 4: stream(b"q 100 0 0 50 0 0 cm /Im0 Do Q"), 5: image})


@pytest.mark.parametrize("how", [{}, {"deflate": False}, {"length": b"9999"}])
def test_text_of_pages(how):
    pages = list(pdf.read_pages(digital(LINES, **how)))
    assert [(k, t) for k, t, _ in pages] == [(0, TEXT), (1, TEXT + "more")] and pages[0][2] is None


def test_maps_to_unicode_and_object_streams():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <00790079>] endbfrange"
    inside = b"1 0 2 37 5 83 " + b"<< /Type /Catalog /Pages 2 0 R >>    " + b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>     " + b"<< /ToUnicode 6 0 R >>"
    file = built({3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F0 5 0 R >> >> >>", 4: stream(b"BT /F0 1 Tf <00010002001000110012002000217777> Tj ET"), 6: stream(cmap), 7: stream(inside, b"/Type /ObjStm /N 3 /First 14")})
    assert [t for _, t, _ in pdf.read_pages(file)] == ["A\U0001f600abcxyy"]


def test_images_of_scanned_pages():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (_, text, image), = pdf.read_pages(scanned(grey))
    assert text == "" and image[:2] == (4, 3) and image[2] == np.repeat(grey[:, :, None], 3, axis=2).tobytes()
    colour = np.random.default_rng(1).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    rows = []
    for k, row in enumerate(colour.astype(int)):  # each PNG filter in turn
        left = np.vstack([[0, 0, 0], row[:-1]])
        up = colour[k - 1].astype(int) if k else np.zeros((6, 3), dtype=int)
        corner = np.vstack([[0, 0, 0], up[:-1]])
        guess = left + up - corner
        far = np.stack([abs(guess - x) for x in (left, up, corner)])
        paeth = np.choose(far.argmin(axis=0), [left, up, corner])
        rows.append(bytes([k]) + ((row - [0 * left, left, up, (left + up) // 2, paeth][k]) & 255).astype(np.uint8).tobytes())
    file = scanned(colour, b"/DecodeParms << /Predictor 15 /Colors 3 /Columns 6 >>", b"".join(rows))
    assert next(pdf.read_pages(file))[2] == (6, 5, colour.tobytes())
    assert next(pdf.read_pages(scanned(grey).replace(b"/DeviceGray", b"/DeviceCMYK")))[2] is None


def test_files_through_spark(spark, tmp_path):
    files = {"a.pdf": digital(LINES), "b.pdf": scanned(np.zeros((2, 2), dtype=np.uint8)), "c.pdf": b"no file of this kind", "d.pdf": digital(LINES) + b"/Encrypt 9 0 R", "e.pdf": built({1: b"<< /Type /Catalog >>"}), "f.pdf": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {(r["path"].rsplit("/", 1)[1], r["page"]): r for r in pdf.pdf_pages(spark, f"{tmp_path}/*.pdf").collect()}
    assert set(rows) == {("a.pdf", 0), ("a.pdf", 1), ("b.pdf", 0), ("c.pdf", None), ("d.pdf", None)}
    assert "not a PDF" in rows["c.pdf", None]["error"] and "encrypted" in rows["d.pdf", None]["error"] and rows["a.pdf", 1]["error"] is None
    pages = texts.pdf_pages(spark, f"{tmp_path}/*.pdf")
    assert pages.count() == 3
    kinds = {(r["kind"], r["extractable_chars"] > 0) for r in raster.page_kinds(pages).collect()}
    assert kinds == {("digital", True), ("raster", False)}
    assert {r["kind"] for r in raster.page_kinds(pages, force_ocr=True).collect()} == {"raster"}
    found = patterns.detect_patterns(pages.where("page = 0").select("doc_id", "text"))
    assert [r["text"] for r in found.where("type = 'PHONE'").collect()] == [PHONE]
    burnt = raster.burnt_pages(pages.where("rgb is not null"), pages.limit(0).selectExpr("doc_id", "page", "struct(0 x0, 0 y0, 0 x1, 0 y1) box"))
    assert burnt.first()["png"].startswith(b"\x89PNG")


def test_replies_and_names_of_models():
    quiet = models.make_client(models.Settings(local_url="http://host:1/"), " Gemma_Local ", lambda url, *a: json.dumps({"url": url}).encode())
    assert quiet.complete(system="s", user="u") == ""
    seen = []
    models.make_client(models.Settings(local_url="http://host:1/"), "LOCAL", lambda url, *a: seen.append(url) or b"{}").complete(system="s", user="u")
    assert seen == ["http://host:1/api/chat"]

    def down(*a):
        raise OSError("gone")

    for name, code in (("local", "llm_backend_unavailable"), ("other", "unknown_model_flag")):
        with pytest.raises(SpanError) as e:
            models.make_client(models.Settings(), name, down).complete(system="s", user="u")
        assert e.value.code == code
