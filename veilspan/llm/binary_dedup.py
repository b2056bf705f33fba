"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector's code is the sign pattern of its randomly rotated direction o; with c = the direction of the code, the
stored factor is <c, o>. For another direction q the product <c, q> / <c, o> estimates <o, q> without bias, and
its error is at most sin(angle) * sqrt(1 - <c, o>^2) / <c, o>. A pair whose cosine reaches the threshold therefore
never has an estimate under ``threshold - sqrt(1 - threshold^2) * sqrt(1 - f^2) / f``. Pairs below that bound are
ruled out by their codes; only the others are recomputed exactly, in double precision.

Codes, factors and a six-bit form of the rotated directions with its rounding error are computed and stored once. They
are a sixth of the vectors, and they alone are dealt out to all pairs of chunks, where <c, q> is counted in bits: for
each of the six bit planes of q the bits it shares with c. Vectors are fetched for rows of undecided pairs only, a row
once for each pair of chunks. Only counts and a spanning forest of the links leave a task, so a large group of copies
doesn't become all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_labels, stored, tidy
from .components import connected_components
from .vectors import chunked, scaled, usable

CHUNK_ROWS = 16384
#: Rows of a chunk whose estimates are held at once.
STRIP = 64
#: Bits of a rounded component, and the largest component that it shows, in standard deviations of a random direction.
PLANES, SPREAD = 6, 4.0


def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


class Coded:
    """Rotated directions, binary codes and correction factors of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.width = vectors.shape[1]
        own, _ = scaled(vectors)
        self.rotated = ((own / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]) @ rotation(self.width).T).astype(np.float32)
        self.factors = np.einsum("ij,ij->i", self.signs, self.rotated)

    @property
    def signs(self) -> np.ndarray:
        """The directions of the codes."""
        return np.where(self.rotated > 0, np.float32(1), np.float32(-1)) / np.float32(np.sqrt(self.width))

    def codes(self) -> np.ndarray:
        return packed(self.rotated > 0)

    def planes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bit planes of the rounded directions, low bit first; sums of the rounded components; lengths of what rounding took)."""
        top, middle = (1 << PLANES) - 1, ((1 << PLANES) - 1) / 2
        step = grain(self.width)
        steps = np.clip(np.rint(self.rotated / step + middle), 0, top).astype(np.uint8)
        lost = np.linalg.norm(self.rotated - (steps - middle) * step, axis=1)
        return np.stack([packed((steps >> k) & 1) for k in range(PLANES)], axis=1), steps.sum(axis=1, dtype=np.int64), lost


def grain(width: int) -> float:
    """The step of the rounded components."""
    return SPREAD / np.sqrt(width) / (((1 << PLANES) - 1) / 2)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits.astype(bool), axis=1, bitorder="little")
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view("<u8")


def floors(factors: np.ndarray, threshold: float) -> np.ndarray:
    """For each factor the least <c, q> of a direction q that reaches the threshold, less what rounding may take."""
    f = np.clip(factors.astype(np.float64), 1e-6, 1)
    return threshold * f - np.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(1 - f * f) - 1e-4


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def undecided(a: Side, b: Side, width: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b are in a pair that the codes of b and the rounded directions of a don't rule out.

    A side holds codes, factors, planes, sums and rounding errors. Within one chunk a row's pair with itself doesn't count.
    """
    codes, factors = b[0], b[1]
    planes, sums, lost = a[2], a[3], a[4]
    middle, per = ((1 << PLANES) - 1) / 2, np.sqrt(width) / (2 * grain(width))
    least_b = floors(factors, threshold) * per + middle * np.bitwise_count(codes).sum(axis=1, dtype=np.int64) - middle * width / 2
    least_a = sums / 2 - lost * per
    kind = np.uint16 if ((1 << PLANES) - 1) * width < 1 << 16 else np.uint32
    in_a, in_b = np.zeros(len(planes), dtype=bool), np.zeros(len(codes), dtype=bool)
    for low in range(0, len(planes), STRIP):
        shared = np.zeros((min(STRIP, len(planes) - low), len(codes)), dtype=kind)
        for k in reversed(range(PLANES)):
            shared <<= 1
            for w in range(codes.shape[1]):
                shared += np.bitwise_count(planes[low : low + STRIP, k, w, None] & codes[None, :, w])
        open_ = shared >= (least_a[low : low + STRIP, None] + least_b[None, :]).astype(np.float32) - np.float32(0.01)
        if same:
            each = np.arange(len(open_))
            open_[each, low + each] = False
        in_a[low : low + STRIP] = open_.any(axis=1)
        in_b |= open_.any(axis=0)
    return in_a, in_b


def links_between(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in a and b of the pairs whose cosine reaches the threshold; within one set of rows each pair once."""
    (a, _), (b, _) = scaled(a), scaled(b)
    na, nb = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
    unit_a, unit_b, xs, ys = a / na[:, None], b / nb[:, None], [], []
    for low in range(0, len(a), STRIP):
        x, y = np.nonzero(unit_a[low : low + STRIP] @ unit_b.T >= threshold - 1e-9)
        x += low
        if same:
            x, y = x[x < y], y[x < y]
        for at in range(0, len(x), 65536):
            p, q = x[at : at + 65536], y[at : at + 65536]
            cosines = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
            xs.append(p[cosines >= threshold])
            ys.append(q[cosines >= threshold])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that have links; roots are the smallest nodes of their components."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    touched = np.unique(np.concatenate([x, y])) if len(x) else np.empty(0, np.int64)
    return touched, label[touched]


CODES = ["chunk", "width", "keys", "codes", "factors", "planes", "sums", "lost"]


def _side(parts: pd.DataFrame, width: int) -> tuple[np.ndarray, Side]:
    """(keys, codes with what belongs to them) of a chunk's stored parts."""
    words = -(-width // 64)
    keys, codes, factors, planes, sums, lost = (np.frombuffer(b"".join(parts[n]), dtype=t) for n, t in zip(CODES[2:], ("<i8", "<u8", "<f4", "<u8", "<i8", "<f8"), strict=True))
    return keys, (codes.reshape(-1, words), factors, planes.reshape(-1, PLANES, words), sums, lost)


def dedup(embeddings: DataFrame, threshold: float = 0.95, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links vectors whose cosine is ``threshold`` or more.

    Returns a row for each row: ``vec_id, n_links long`` (other rows linked directly), ``component_id long``
    (smallest vec_id reachable by links, itself included), ``kept boolean`` (vec_id = component_id). Vectors that
    are null, zero or hold null or non-finite components link with nothing. Rows that share an id, and repeated
    rows, are rows of their own; usable vectors of different numbers of components raise. A null vec_id counts as larger than any other and is kept only where alone.
    Further columns are ignored; an empty table gives no rows.
    """
    total = embeddings.count()
    chunks = max(1, -(-total // chunk_rows))
    parts = stored(chunked(embeddings, chunks), "vectors", "lz4")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                vectors = np.frombuffer(raw.as_buffer(), dtype="<f8").reshape(len(keys.as_buffer()) // 8, -1)
                c = Coded(vectors)
                made = [c.codes(), c.factors, *c.planes()]
                kinds = ("<u8", "<f4", "<u8", "<i8", "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int32()), pa.array([c.width], pa.int32()), pa.array([keys.as_py()], pa.binary()), *[pa.array([np.ascontiguousarray(x, dtype=t).tobytes()], pa.binary()) for x, t in zip(made, kinds, strict=True)]], names=CODES)

    codes = stored(parts.select("chunk", "keys", "vectors").mapInArrow(tidy(coded), "chunk int, width int, " + ", ".join(f"{n} binary" for n in CODES[2:])), "codes", "lz4")
    own = ("width", *CODES[2:])
    left = codes.withColumn("other", F.explode(F.sequence(F.col("chunk"), F.lit(chunks - 1)))).select(F.col("chunk").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), *own)
    right = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunk")))).where("other < chunk").select(F.col("other").alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("left"), *own)

    def by_codes(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        same, width = key[0] == key[1], int(group["width"].iloc[0])
        if group["width"].nunique() > 1:
            raise ValueError("vectors of different numbers of components")
        sides = [_side(g, width) for g in ([group] if same else [group[group["left"]], group[~group["left"]]]) if len(g)]
        rows = [np.empty(0, np.int64), np.empty(0, np.int64)]
        if same:
            in_a, in_b = undecided(sides[0][1], sides[0][1], width, threshold, True)
            rows[0] = sides[0][0][in_a | in_b]
        elif len(sides) == 2:
            in_a, in_b = undecided(sides[0][1], sides[1][1], width, threshold, False)
            rows = [sides[0][0][in_a], sides[1][0][in_b]]
        give_back()
        both = np.concatenate(rows)
        return pd.DataFrame({"i": np.full(len(both), key[0]), "j": np.full(len(both), key[1]), "left": np.arange(len(both)) < len(rows[0]), "key": both})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(keys.as_buffer(), dtype="<i8")
                size = len(raw.as_buffer()) // max(1, len(own))
                data = raw.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([data[k * size : (k + 1) * size] for k in range(len(own))], pa.binary())], names=["key", "vector"])

    def exact(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["left", "key"], ascending=[False, True])
        keys, split = group["key"].to_numpy(), int(group["left"].sum())
        vectors = np.frombuffer(b"".join(group["vector"]), dtype="<f8").reshape(len(keys), -1)
        same = key[0] == key[1]
        x, y = links_between(vectors[:split], vectors[:split] if same else vectors[split:], threshold, same)
        y = y if same else y + split
        nodes, roots = forest(len(keys), x, y)
        counts = np.bincount(np.concatenate([x, y]), minlength=len(keys))
        return pd.DataFrame({"key": keys[nodes], "n": counts[nodes], "to": keys[roots]})

    wanted = stored(left.unionByName(right).groupBy("i", "j").applyInPandas(by_codes, "i int, j int, left boolean, key long"), "undecided")
    fetched = wanted.join(parts.select("keys", "vectors").mapInArrow(tidy(single), "key long, vector binary"), "key")
    met = stored(fetched.groupBy("i", "j").applyInPandas(exact, "key long, n long, to long"), "links")
    roots = connected_components(met.where("key <> to").select(F.col("key").alias("a"), F.col("to").alias("b")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1), strict=True):
                keys, ids = (np.frombuffer(x.as_buffer(), dtype="<i8") for x in (k, v))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=ids == -(2**63))], names=["key", "vec_id"])

    rows = parts.select("keys", "ids").mapInArrow(tidy(listed), "key long, vec_id long")
    rows = rows.join(met.groupBy("key").agg(F.sum("n").alias("n_links")), "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root"))
    rows = stored(rows, "rows")
    labels = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size"), F.count("*").alias("rows"))
    linked = join_labels(rows, stored(labels, "labels"), "root", "rows", total).select("vec_id", "n_links", "component_id", "size")

    def unusable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(batch.num_rows, dtype=bool)
            out[usable(batch, 1)[0]] = False
            yield batch.select([0]).filter(pa.array(out))

    rest = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(tidy(unusable), "vec_id long")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1).cast("long").alias("size"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("size") == 1).alias("kept"))


#: The same rows by all pairs, for DuckDB.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.c, e.vec_id) AS component_id, coalesce(r.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
