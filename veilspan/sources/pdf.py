"""Pages of PDF files: their text, and the image of a scanned page, read from the files' own objects.

Files are rows of Spark's binary reader, so they can lie in any store and are dealt out to tasks. Read are objects and
object streams, deflated and plain streams, the page tree with what pages inherit, fonts' maps to Unicode, and images of 8-bit
grey or RGB samples. Encrypted files, and images in other forms, aren't decoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id long, path string, page int, text string, width int, height int, rgb binary, error string"
SPACE = rb"[\x00\t\n\x0c\r ]"
TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*(<<|>>|[\[\](]|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|[{})>])")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
OBJECT = re.compile(rb"(?<!\d)(\d+)" + SPACE + rb"+\d+" + SPACE + rb"+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a line of text, in thousandths of the font's size, from which on words are apart.
WORD_GAP = 180


class Name(str):
    """A name; a plain str is an operator."""


@dataclass(frozen=True)
class Ref:
    number: int


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The literal string whose opening bracket ends before ``at``, and where it ends."""
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
            elif data[at : at + 2] == b"\r\n":
                at += 2
            else:
                e = data[at : at + 1]
                out.append(b"" if e in b"\r\n" else ESCAPES.get(e, e))
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values and operators of a piece of a file, each with where it ends; containers are whole."""
    stack: list[list] = []
    while m := TOKEN.match(data, at):
        token, at = m[1], m.end()
        if token in (b"<<", b"["):
            stack.append([token])
            continue
        if token in (b">>", b"]"):
            if not stack:
                return
            kind, *own = stack.pop()
            value = own if kind == b"[" else {str(k): v for k, v in zip(own[::2], own[1::2], strict=False)}
        elif token == b"(":
            value, at = _string(data, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(token[1:].decode("latin-1"))
        elif NUMBER.match(token):
            value = float(token) if b"." in token else int(token)
        elif token == b"R" and stack and len(stack[-1]) > 2:
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, token.decode("latin-1"))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class File:
    """The objects of a file; of several with one number the last counts."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.places = data, {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        self.inside: dict[int, object] = {}
        self.known: dict[int, object] = {}
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("encrypted")
        for n in list(self.places):
            own = self.get(Ref(n))
            if isinstance(own, tuple) and own[0].get("Type") == "ObjStm":
                body = self.decoded(own)
                heads = [v for v, _ in values(body[: self.get(own[0]["First"])])]
                for number, offset in zip(heads[::2], heads[1::2], strict=False):
                    self.inside[number] = next(values(body, self.get(own[0]["First"]) + offset), (None, 0))[0]

    def get(self, value: object) -> object:
        """What a reference stands for: a value, or (dictionary, raw bytes) for a stream."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            if value.number not in self.known:
                self.known[value.number] = self._read(value.number)
            value = self.known[value.number]
        return None

    def _read(self, number: int) -> object:
        if number not in self.places:
            return self.inside.get(number)
        own, at = next(values(self.data, self.places[number]), (None, 0))
        start = re.compile(SPACE + rb"*stream\r?\n").match(self.data, at)
        if not isinstance(own, dict) or not start:
            return own
        size = self.get(own.get("Length"))
        end = start.end() + size if isinstance(size, int) else -1
        if end < 0 or not re.compile(SPACE + rb"*endstream").match(self.data, end):
            end = self.data.find(b"endstream", start.end())
        return own, self.data[start.end() : end]

    def decoded(self, stream: object) -> bytes:
        """A stream's bytes; those of filters other than Flate raise."""
        own, data = stream
        filters = self.get(own.get("Filter")) or []
        parms = self.get(own.get("DecodeParms")) or {}
        for k, name in enumerate(filters if isinstance(filters, list) else [filters]):
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name}")
            data = zlib.decompressobj().decompress(data)
            parm = self.get(parms[k]) if isinstance(parms, list) else parms
            data = _unpredicted(data, parm or {})
        return data

    def pages(self) -> Iterator[dict]:
        """The leaves of the page tree in order, each with what it inherits."""
        catalogs = [c for n in [*self.places, *self.inside] if isinstance(c := self.get(Ref(n)), dict) and c.get("Type") == "Catalog"]
        seen: set[int] = set()
        work = [(catalogs[-1].get("Pages"), {})] if catalogs else []
        while work:
            ref, inherited = work.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.number in seen):
                continue
            seen |= {ref.number} if isinstance(ref, Ref) else set()
            own = inherited | {k: v for k, v in node.items() if k in ("Resources", "MediaBox")}
            if "Kids" in node:
                work += [(kid, own) for kid in reversed(self.get(node["Kids"]) or [])]
            else:
                yield own | node

    def resource(self, page: dict, kind: str) -> dict:
        return self.get((self.get(page.get("Resources")) or {}).get(kind)) or {}

    def text(self, page: dict) -> str:
        """The text that a page shows, in the order of its operators; a move to another line is a line feed."""
        parts = self.get(page.get("Contents")) or []
        parts = [self.get(p) for p in parts] if isinstance(parts, list) else [parts]
        data = b"\n".join(self.decoded(p) for p in parts if isinstance(p, tuple))
        fonts = {name: self._letters(self.get(f) or {}) for name, f in self.resource(page, "Font").items()}
        out: list[str] = []
        args: list = []
        letters, height = _plain, None

        def apart(sign: str) -> None:
            if out and out[-1] not in (" ", "\n"):
                out.append(sign)

        for value, _ in values(data):
            if not isinstance(value, str) or isinstance(value, Name):
                args.append(value)
                continue
            if value == "Tf" and len(args) > 1:
                letters = fonts.get(args[-2], _plain)
            elif value in ("T*", "'", '"') or value in ("Td", "TD") and len(args) > 1 and args[-1]:
                apart("\n")
            elif value in ("Td", "TD"):
                apart(" ")
            elif value == "Tm" and len(args) > 5:
                apart("\n" if args[-1] != height else " ")
                height = args[-1]
            if value in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                out.append(letters(args[-1]))
            elif value == "TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, bytes):
                        out.append(letters(x))
                    elif isinstance(x, (int, float)) and x < -WORD_GAP:
                        apart(" ")
            args = []
        return "".join(out)

    def _letters(self, font: dict):
        """A function from a shown string to its text."""
        mapped = self.get(font.get("ToUnicode"))
        if not isinstance(mapped, tuple):
            return _plain
        table, width = _unicode_map(self.decoded(mapped))
        return lambda s: "".join(table.get(s[k : k + width], _plain(s[k : k + width]) if width == 1 else "") for k in range(0, len(s), width))

    def image(self, page: dict) -> tuple[int, int, bytes] | None:
        """(width, height, RGB) of a page's largest image, if its samples can be read."""
        images = [x for x in map(self.get, self.resource(page, "XObject").values()) if isinstance(x, tuple) and x[0].get("Subtype") == "Image" and self.get(x[0].get("BitsPerComponent")) == 8]
        for own in sorted(images, key=lambda x: -(self.get(x[0]["Width"]) * self.get(x[0]["Height"]))):
            width, height = self.get(own[0]["Width"]), self.get(own[0]["Height"])
            colours = {"DeviceRGB": 3, "DeviceGray": 1}.get(self.get(own[0].get("ColorSpace")))
            try:
                samples = np.frombuffer(self.decoded(own), dtype=np.uint8)
            except (ValueError, zlib.error):
                continue
            if colours and samples.size >= width * height * colours:
                pixels = samples[: width * height * colours].reshape(height, width, colours)
                return width, height, np.repeat(pixels, 3 // colours, axis=2).tobytes()
        return None


def _plain(s: bytes) -> str:
    return s[2:].decode("utf-16-be", "replace") if s[:2] == b"\xfe\xff" else s.decode("cp1252", "replace")


def _unpredicted(data: bytes, parm: dict) -> bytes:
    """Rows of samples without the differences that PNG's filters made of them."""
    if parm.get("Predictor", 1) < 10:
        return data
    step = max(1, parm.get("Colors", 1) * parm.get("BitsPerComponent", 8) // 8)
    width = (parm.get("Columns", 1) * parm.get("Colors", 1) * parm.get("BitsPerComponent", 8) + 7) // 8
    out, above = [], bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for k in range(width):
            left, up, corner = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            near = min((left, up, corner), key=lambda x: abs(left + up - corner - x))
            row[k] = (row[k] + (0, left, up, (left + up) // 2, near)[kind]) & 255
        out.append(bytes(row))
        above = row
    return b"".join(out)


def _unicode_map(data: bytes) -> tuple[dict[bytes, str], int]:
    """Codes with their text, and the bytes of a code."""
    table: dict[bytes, str] = {}
    args: list = []
    for value, _ in values(data):
        if value == "endbfchar":
            table |= {code: text.decode("utf-16-be", "replace") for code, text in zip(args[::2], args[1::2], strict=False)}
        elif value == "endbfrange":
            for low, high, to in zip(args[::3], args[1::3], args[2::3], strict=False):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(last - first, 0xFFFF) + 1):
                    text = to[k] if isinstance(to, list) else to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big")
                    table[(first + k).to_bytes(len(low), "big")] = text.decode("utf-16-be", "replace")
        if isinstance(value, str) and not isinstance(value, Name):
            args = []
        else:
            args.append(value)
    return table, max((len(k) for k in table), default=1)


def read_pages(data: bytes) -> Iterator[tuple[int, str, tuple[int, int, bytes] | None]]:
    """(page from 0, text, image) of a file's pages."""
    file = File(data)
    for k, page in enumerate(file.pages()):
        yield k, file.text(page), file.image(page)


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the PDF files under a path: doc_id (a hash of the path), path, page (from 0), text, width, height, rgb, error.

    A page without a readable image has null for its pixels. A file that can't be read gives one row without a page,
    with its ``error``; the pages before the fault stay. Files without bytes and without pages give none.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())

        def row(*cells) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, at, content in zip(*(batch.column(j) for j in range(3)), strict=True):
                try:
                    for page, text, image in read_pages(content.as_py()):
                        yield row(doc.as_py(), at.as_py(), page, text, *(image or (None, None, None)), None)
                except (ValueError, KeyError, TypeError, IndexError, zlib.error) as error:
                    yield row(doc.as_py(), at.as_py(), None, None, None, None, None, f"{type(error).__name__}: {error}")

    return files.mapInArrow(run, PAGES)
