"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Vectors are first made points whose Euclidean distance falls as the inner product rises: divided by the largest
norm and given one more component that brings them to length 1, while queries are given a zero there. Each table
hashes a point by floor((a . x + b) / w) for a few Gaussian directions a. For a query, the buckets of a table are
visited in descending order of their estimated success: the chance that a neighbour at a given distance falls
into them, each direction's share of it a normal probability. A table's visits end when the chance that all tables
together have met the neighbour reaches the target. Candidates of all tables are merged and ranked by the exact
inner product.

A query's first visits are for the expected distance, one number for all. Its own ``k``-th best candidate then tells
how far its neighbours may be: where that is farther, it visits again for its own distance. Where there are fewer than
``k`` candidates, or the buckets within reach don't give the target, it is held against every vector of the chunk.

Every chunk of vectors has its own tables, and every query visits every chunk; chunks and queries are dealt out in
blocks of bounded size, so no row set is gathered in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .vectors import chunked, joined_parts, scaled, unit

CHUNK_ROWS, QUERY_ROWS = 16384, 1024
#: Queries whose candidates are held at once.
PART_QUERIES = 128
TABLES, DIRECTIONS, REACH = 6, 4, 3
#: Bound of the sample that the expected distance and the bucket width are fitted on.
SAMPLE_ROWS = 4096
NULL_ID = -(2**63)


class Hashes:
    """The directions, shifts and probe order that all chunks share."""

    def __init__(self, width: int, bucket: float, distance: float, target: float, seed: int = 5):
        random = np.random.default_rng(seed)
        self.bucket, self.distance, self.target = bucket, distance, target
        self.directions = random.normal(size=(TABLES, width, DIRECTIONS))
        self.shifts = random.uniform(0, bucket, size=(TABLES, DIRECTIONS))
        self.steps = np.array(sorted(itertools.product(range(-REACH, REACH + 1), repeat=DIRECTIONS), key=lambda s: (sum(map(abs, s)), s)))

    def places(self, points: np.ndarray, table: int) -> np.ndarray:
        """Positions in units of buckets."""
        return (points @ self.directions[table] + self.shifts[table]) / self.bucket

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """One number for each cell; cells are far from its range's ends for unit vectors."""
        out = np.zeros(cells.shape[:-1], dtype=np.int64)
        for k in range(cells.shape[-1]):
            out = out * 4096 + (cells[..., k].astype(np.int64) + 2048) % 4096
        return out

    def probes(self, places: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, bucket key) of all visits for each query's distance, in order of estimated success; whether they reach the target."""
        cells = np.floor(places)
        inside = places - cells
        spread = (distance / self.bucket)[:, None, None]
        edges = np.arange(-REACH, REACH + 2)[None, None, :] - inside[:, :, None]
        below = _normal(edges / spread)
        chance = below[:, :, 1:] - below[:, :, :-1]
        success = np.ones((len(places), len(self.steps)))
        for k in range(DIRECTIONS):
            success *= chance[:, k, :][:, self.steps[:, k] + REACH]
        order = np.argsort(-success, axis=1, kind="stable")
        ranked = np.take_along_axis(success, order, axis=1)
        missed = (1 - self.target) ** (1 / TABLES)
        visited = np.cumsum(ranked, axis=1) - ranked < 1 - missed
        query, place = np.nonzero(visited)
        return query, self.keys(cells[query] + self.steps[order[query, place]]), ranked.sum(axis=1) >= 1 - missed


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by interpolation in a table."""
    return np.interp(x, _GRID, _VALUES)


_GRID = np.linspace(-8, 8, 4001)
_VALUES = np.array([0.5 * (1 + erf(x / sqrt(2))) for x in _GRID])


def as_points(vectors: np.ndarray, largest: float) -> np.ndarray:
    own = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", own, own)))
    return np.concatenate([own, rest[:, None]], axis=1)


def as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([unit(vectors), np.zeros((len(vectors), 1))], axis=1)


def largest_norm(vectors: np.ndarray) -> float:
    own, exponent = scaled(vectors)
    with np.errstate(over="ignore"):
        return float(np.minimum(np.ldexp(np.sqrt(np.einsum("ij,ij->i", own, own)), exponent), np.finfo(float).max).max())


def search(hashes: Hashes, vectors: np.ndarray, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_keys: np.ndarray, largest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vector row, score) of each query's ``k`` best among its candidates in this chunk; the number of candidates.

    Products are made for a query's candidates only. Queries are taken in parts, so what is held of candidates is bounded.
    """
    points, asked = as_points(vectors, largest), as_queries(queries)
    tables = []
    for t in range(TABLES):
        own = hashes.keys(np.floor(hashes.places(points, t)))
        order = np.argsort(own, kind="stable")
        tables.append((order, *np.unique(own[order], return_index=True, return_counts=True), hashes.places(asked, t)))
    rows, columns, scores, candidates = [], [], [], 0
    for low in range(0, len(queries), PART_QUERIES):
        part = np.arange(low, min(low + PART_QUERIES, len(queries)))
        for q, own, rough in _candidates(hashes, tables, points, asked, keys, query_keys, part, k):
            candidates += len(own)
            # The product of directions rounds otherwise: it leaves those that may be among the best, which are scored anew.
            if len(rough) > k:
                own = own[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            score = np.einsum("ij,j->i", vectors[own], queries[q])
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                own, score = own[score >= least], score[score >= least]
            best = np.lexsort((ids[own], -score))[:k]
            rows.append(np.full(len(best), q))
            columns.append(own[best])
            scores.append(score[best])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores), candidates


def _candidates(hashes: Hashes, tables: list[tuple], points: np.ndarray, asked: np.ndarray, keys: np.ndarray, query_keys: np.ndarray, part: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its candidates, their products) for a part of the queries; of the second visits only what is new is multiplied."""
    met = np.zeros((len(part), len(points)), dtype=bool)

    def visit(which: np.ndarray, distance: np.ndarray) -> None:
        for order, buckets, first, size, places in tables:
            query, bucket, whole = hashes.probes(places[part[which]], distance)
            at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
            hit = buckets[at] == bucket
            query, at = query[hit], at[hit]
            n = size[at]
            spot = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            met[which[np.repeat(query, n)], order[spot]] = True
            met[which[~whole]] = True

    other = keys[None, :] != query_keys[part][:, None]
    visit(np.arange(len(part)), np.full(len(part), hashes.distance))
    met &= other
    far = np.full(len(part), np.inf)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for j, q in enumerate(part):
        own = np.flatnonzero(met[j])
        rough = points[own] @ asked[q]
        known.append((own, rough))
        if len(own) >= k:
            far[j] = np.sqrt(max(1e-6, 2 - 2 * np.partition(rough, len(rough) - k)[len(rough) - k]))
    met[np.isinf(far)] = True
    again = np.flatnonzero(np.isfinite(far) & (far > hashes.distance))
    if len(again):
        visit(again, far[again])
    met &= other
    for j, q in enumerate(part):
        own, rough = known[j]
        met[j, own] = False
        fresh = np.flatnonzero(met[j])
        yield q, np.concatenate([own, fresh]), np.concatenate([rough, points[fresh] @ asked[q]])


def fit(sample: np.ndarray, largest: float, total: int, k: int, target: float) -> Hashes:
    """The expected distance of the k-th neighbour, from a bounded sample of vectors.

    Of ``total`` vectors a sample holds fewer near ones, so the sample's rank is scaled down; the median over the
    sampled queries counts.
    """
    points, asked = as_points(sample, largest), as_queries(sample[:512])
    products = asked @ points.T
    products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    rank = int(np.clip(round(k * len(sample) / max(total, 1)), 1, max(1, len(sample) - 1)))
    near = np.sort(products, axis=1)[:, -rank] if len(sample) > 1 else np.ones(len(asked))
    return Hashes(sample.shape[1] + 1, bucket=1.0, distance=float(np.sqrt(max(1e-6, 2 - 2 * np.quantile(near, 0.5)))), target=target)


def nearest(embeddings: DataFrame, query_filter: str = "vec_id % 20 = 0", k: int = 20, target: float = 0.95) -> DataFrame:
    """The ``k`` nearest rows found for each query row, by largest inner product in double precision.

    Queries are the rows that ``query_filter`` names; candidates are all rows but the query's own (other rows with
    the same id are candidates). Returns ``query_id, rank int (from 1), vec_id, score double``, nearest first, ties
    to the smaller vec_id, repeated rows as often as they stand; fewer rows where there are fewer candidates.
    Vectors that are null, zero or hold null or non-finite components, and rows with a null vec_id, take no part.
    Further columns are ignored; an empty table gives no rows. All rows are indexed; only the distance that
    the first visits are for is fitted on a sample of at most ``SAMPLE_ROWS`` rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null")
    total = rows.count()
    chunks, lots = max(1, -(-total // CHUNK_ROWS)), max(1, -(-rows.where(query_filter).count() // QUERY_ROWS))
    marked = rows.select("vec_id", "embedding", F.expr(query_filter).alias("asked"))
    base = stored(chunked(marked, chunks, "asked"), "vectors", "lz4")

    def norms(batches):
        import pyarrow as pa

        for batch in batches:
            for raw, keys in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype="<f8").reshape(len(keys.as_buffer()) // 8, -1)
                yield pa.RecordBatch.from_arrays([pa.array([largest_norm(x)])], names=["norm"])

    largest = base.select("vectors", "keys").mapInArrow(tidy(norms), "norm double").agg(F.max("norm")).first()[0]
    layout = "query_id long, query_key long, vec_id long, score double"
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample, held = [], 0
    for row in base.drop("marks").orderBy(F.xxhash64("chunk", "keys")).limit(16).toLocalIterator():
        x = joined_parts([(row["keys"], row["ids"], row["vectors"])])[2][: SAMPLE_ROWS - held]
        sample.append(x)
        held += len(x)
        if held >= SAMPLE_ROWS:
            break
    hashes = fit(np.concatenate(sample), largest, total, k, target)

    def asked_only(batches):
        import pyarrow as pa

        for batch in batches:
            for c, keys, ids, vectors, marks in zip(*(batch.column(j) for j in range(5)), strict=True):
                ids_ = np.frombuffer(ids.as_buffer(), dtype="<i8")
                own = np.flatnonzero(np.frombuffer(marks.as_buffer(), dtype=np.uint8))
                x = np.frombuffer(vectors.as_buffer(), dtype="<f8").reshape(len(ids_), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c.as_py(), dtype=np.int32)), pa.array(np.frombuffer(keys.as_buffer(), dtype="<i8")[own]), pa.array(ids_[own]), pa.array([x[k].tobytes() for k in own], pa.binary())], names=["chunk", "key", "id", "vector"])

    single = base.select("chunk", "keys", "ids", "vectors", "marks").mapInArrow(tidy(asked_only), "chunk int, key long, id long, vector binary")
    queries = stored(single.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(lots)).cast("int")).select("lot", "key", "id", "vector"), "queries", "lz4")
    left = base.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select("chunk", "lot", "keys", "ids", "vectors")
    right = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("chunk", "lot", "key", "id", "vector")

    def run(key: tuple, blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(asked):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_key": "int64", "vec_id": "int64"})
        keys, ids, vectors = joined_parts(list(blocks[["keys", "ids", "vectors"]].itertuples(index=False, name=None)))
        asked = asked.sort_values("key")
        x = np.frombuffer(b"".join(asked["vector"]), dtype="<f8").reshape(len(asked), -1)
        q, v, score, _ = search(hashes, vectors, keys, ids, x, asked["key"].to_numpy(), largest, k)
        return pd.DataFrame({"query_id": asked["id"].to_numpy()[q], "query_key": asked["key"].to_numpy()[q], "vec_id": ids[v], "score": score})

    found = left.groupBy("chunk", "lot").cogroup(right.groupBy("chunk", "lot")).applyInPandas(run, layout)
    from pyspark.sql import Window

    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
