"""Scanned pages: kinds of pages, text from recognised words, boxes of spans, and pixels burnt over.

Page text, words and images come from functions that are passed in; reading PDF files and recognising words need
libraries that aren't part of this package.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bins, pairs

#: Fixed value: a page with fewer characters has no text layer worth the name.
DIGITAL_MIN_CHARS = 10
WORDS = "doc_id long, page int, ord int, text string, conf string, block int, par int, line int, left int, top int, width int, height int"


def page_kinds(pages: DataFrame, force_ocr: bool = False) -> DataFrame:
    """doc_id, page, kind (digital or raster), extractable_chars for rows doc_id, page, text."""
    chars = F.lit(0) if force_ocr else F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+\z", ""))
    return pages.select("doc_id", "page", F.when(F.lit(force_ocr) | (chars < DIGITAL_MIN_CHARS), "raster").otherwise("digital").alias("kind"), chars.alias("extractable_chars"))


def placed_words(words: DataFrame) -> DataFrame:
    """Words with their offsets in the page's text: doc_id, page, ord, text, start, end, box.

    Blank words and words of a confidence under 0, or none, are left out. Words of a line are joined by a space,
    lines by a line feed.
    """
    kept = words.withColumn("conf", F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0))).where(F.col("text").rlike(r"(?U)\S") & (F.col("conf") >= 0))
    order = Window.partitionBy("doc_id", "page").orderBy("ord")
    line = F.struct("block", "par", "line")
    before = F.lag(line).over(order)
    kept = kept.withColumn("sep", F.when(before.isNull(), "").when(before != line, "\n").otherwise(" "))
    end = F.sum(F.length("sep") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    box = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    return kept.withColumn("end", end).select("doc_id", "page", "ord", "text", "sep", (F.col("end") - F.length("text")).alias("start"), "end", box.alias("box"))


def page_texts(placed: DataFrame) -> DataFrame:
    """doc_id, page, text of placed words."""
    lists = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat("sep", "text").alias("piece")))).alias("p"))
    return lists.select("doc_id", "page", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def span_boxes(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, page, start, end, box for every word that a span overlaps; a word under two spans comes twice."""
    own = spans.select("doc_id", "page", "start", "end")
    # Words lie by page already; those in bins that no span touches drop out there, before words and spans are exchanged by bin.
    touched = own.where("start >= 0 and start <= end").select("doc_id", "page", F.explode(bins(F.col("start"), F.col("end"))).alias("bin")).groupBy("doc_id", "page").agg(F.collect_set("bin").alias("bins"))
    near = placed.select("doc_id", "page", "start", "end", "ord", "box").join(touched, ["doc_id", "page"]).where(F.arrays_overlap(bins(F.col("start"), F.col("end")), "bins")).drop("bins")
    met = pairs(own, near, ("doc_id", "page"))
    return met.select("doc_id", "page", "a.start", "a.end", "b.ord", "b.box")


def burnt(pixels: np.ndarray, boxes: Sequence[tuple[int, int, int, int]], pad: int = 1) -> np.ndarray:
    """A copy of an RGB array with each box, padded and clamped, in solid black; the far edges count in."""
    out = np.array(pixels, dtype=np.uint8, copy=True)
    height, width = out.shape[:2]
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0 - pad) : min(height, y1 + pad) + 1, max(0, x0 - pad) : min(width, x1 + pad) + 1] = 0
    return out


def png(pixels: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def burnt_pages(images: DataFrame, boxes: DataFrame, pad: int = 1) -> DataFrame:
    """doc_id, page, png: page images (doc_id, page, width, height, rgb bytes) with the boxes burnt in."""
    lists = boxes.groupBy("doc_id", "page").agg(F.collect_list("box").alias("boxes"))
    rows = images.join(lists, ["doc_id", "page"], "left").select("doc_id", "page", "width", "height", "rgb", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for width, height, rgb, found in zip(batch["width"], batch["height"], batch["rgb"], batch["boxes"], strict=True):
                own = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in found] if found is not None else []
                made.append(png(burnt(np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3), own, pad)))
            yield batch[["doc_id", "page"]].assign(png=made)

    return rows.mapInPandas(run, "doc_id long, page int, png binary")


def recognised_words(images: DataFrame, recogniser: Callable[[bytes, int, int], Sequence[tuple]]) -> DataFrame:
    """Words of page images by a function (rgb, width, height) -> rows (text, conf, block, par, line, left, top, width, height)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WORDS.split(", ")]
        for batch in batches:
            rows = [(d, p, k, str(w[0]), str(w[1]), *w[2:]) for d, p, width, height, rgb in batch[["doc_id", "page", "width", "height", "rgb"]].itertuples(index=False, name=None) for k, w in enumerate(recogniser(rgb, width, height))]
            yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(run, WORDS)
