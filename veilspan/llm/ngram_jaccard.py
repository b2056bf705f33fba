"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering, reduced to connected components.

Every distinct n-gram set is a node. Its n-grams are put in one global order, rare ones first, by a sketch of their
frequencies over all documents; two sets that link share an n-gram within the prefixes of that order. Sets that share
a prefix n-gram are candidates if the length filter, the positional filter and a first suffix filter let them; a
second suffix filter and the intersection then decide once for each pair. Both suffix filters bound the number of
n-grams in just one of two sets from below: the first by the bits in which 256 parities of the two sets differ (a set
has a parity for each residue of its n-grams), so that it can be a join condition, the second by halving the sets.

Pairs are found in two steps, so that a group of many near copies doesn't cost all its pairs. First each set is held
against one centre for each prefix n-gram, the set with the fewest rare n-grams before it. Then only pairs that share a prefix n-gram and still lie in different
components are held against each other, all of them. Pairs within a component can't change it, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import join_labels, slices, stored, tidy
from .components import connected_components
from .shingles import set_id, shingle_sets

#: Counters of the frequency sketch, as powers of two: one for some n-grams, within fixed bounds. The sketch decides the
#: order only, never a result.
SKETCH_BITS, GRAMS_A_COUNTER = (18, 21), 32
PARITIES = ("p0", "p1", "p2", "p3")
#: Candidate documents are looked up by a broadcast of up to so many ids, and by a shuffle join beyond.
BROADCAST_IDS = 1_000_000
#: Sets that share a prefix n-gram are dealt out in lots of about so many before they are held against each other.
LOT_SETS = 2_000


def least_overlap(a, b, percent: int):
    """Smallest intersection size of two linked sets of sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many first n-grams of a set of n meet the prefix of every set linked with it."""
    return n - -((-percent * n) // 100) + 1


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the number of n-grams in just one of two sorted sets, by halving around a pivot."""
    if depth == 0 or len(x) < 4 or len(y) < 4:
        return abs(len(x) - len(y))
    middle = len(x) // 2
    at = int(np.searchsorted(y, x[middle]))
    return suffix_bound(x[:middle], y[:at], depth - 1) + suffix_bound(x[middle:], y[at:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    need = least_overlap(len(x), len(y), percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y) > len(x) + len(y) - 2 * need:
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def parities(x: np.ndarray) -> np.ndarray:
    """256 parities of a set as four 64-bit numbers; those of two sets differ in at most as many bits as the sets in n-grams."""
    odd = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketch_bits(total_chars: int) -> int:
    """The size of the sketch for a corpus, taking six characters for an n-gram."""
    return int(np.clip(max(1, total_chars // 6 // GRAMS_A_COUNTER).bit_length(), *SKETCH_BITS))


def _sets(documents: DataFrame, width: int, bits: int) -> DataFrame:
    """A row for each document: doc_id, mark (a hash of its text), n, node, parities; and a row for each task with its sketch of n-gram frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(1 << bits, dtype=np.uint32), [], 0

        def count() -> None:
            nonlocal held, size
            if held:
                sketch[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, width)
                for x in sets:
                    held.append(x)
                    size += len(x)
                    if size >= 1 << 21:
                        count()
                marks = np.array([parities(x) for x in sets]).reshape(len(sets), 4)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "mark": part.column(1), "n": [len(x) for x in sets], "node": [set_id(x) if len(x) else None for x in sets], **{p: marks[:, k] for k, p in enumerate(PARITIES)}, "sketch": [None] * len(sets)}, schema=layout)
        count()
        yield pa.RecordBatch.from_pydict({f.name: [None] for f in layout} | {"sketch": [np.minimum(sketch, 65535).astype("<u2").tobytes()]}, schema=layout)

    numbers = ("doc_id", "mark", "n", "node", *PARITIES)
    layout = pa.schema([*((c, pa.int64()) for c in numbers), ("sketch", pa.binary())])
    return documents.select(*_row_key(), "text").mapInArrow(tidy(run), f"{', '.join(f'{c} long' for c in numbers)}, sketch binary")


def _row_key() -> tuple[Column, Column]:
    """What tells rows apart; rows with equal ids and texts have the same."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")


def _sketch(sets: DataFrame, bits: int) -> np.ndarray:
    """The frequency sketch of all documents, of bounded size; tasks add up what they read before the driver does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), dtype="<u2")
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], names=["sketch"])

    total = np.zeros(1 << bits, dtype=np.uint32)
    for row in sets.where("sketch is not null").select("sketch").coalesce(4).mapInArrow(tidy(run), "sketch binary").toLocalIterator():
        total += np.frombuffer(row["sketch"], dtype="<u2")
    return np.minimum(total, 65535).astype(np.uint16)


def _prefixes(documents: DataFrame, width: int, percent: int, sketch: Broadcast, bits: int) -> DataFrame:
    """The prefix n-grams of every set: gram, node, n, pos (from 0 in the rare-first order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                grams, nodes, sizes, places, seen = [], [], [], [], set()
                for x in shingle_sets(texts, width):
                    if not len(x) or (node := set_id(x)) in seen:
                        continue
                    seen.add(node)
                    length = prefix_length(len(x), percent)
                    order = np.lexsort((x, sketch.value[(x >> np.uint64(64 - bits)).astype(np.int64)]))[:length]
                    grams.append(x[order])
                    nodes.append(np.full(length, node))
                    sizes.append(np.full(length, len(x)))
                    places.append(np.arange(length))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "node", "n", "pos"])

    return documents.select("text").mapInArrow(tidy(run), "gram long, node long, n int, pos int")


def _may_link(percent: int):
    """The length filter, the positional filter and the suffix filter by parities, on sides a and b."""
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / F.lit(100 + percent))
    length = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    place = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITIES])
    return length & place & (apart <= F.col("a.n") + F.col("b.n") - 2 * need)


def _verified(pairs: DataFrame, sets: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones among distinct candidate pairs ``a, b`` of nodes."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = stored(sets.where("node is not null").join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "candidates")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = texts.alias("t").join(ids.alias("i"), F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch):
                found = {set_id(x): x for x in shingle_sets(part, width) if len(x)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found.values()], pa.binary())], names=["node", "grams"])

    grams = stored(texts.mapInArrow(tidy(hashed), "node long, grams binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "grams", "lz4")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), dtype="<u8") for v in batch.column(k)] for k in (2, 3))
            keep = pa.array([linked(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(decide), "a long, b long")


def _labelled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each row: doc_id, mark, n, node, and root, the node that names its component; node is null without words."""
    bits = sketch_bits(documents.agg(F.sum(F.length("text"))).first()[0] or 0)
    sets = stored(_sets(documents, width, bits), "sets")
    sketch = documents.sparkSession.sparkContext.broadcast(_sketch(sets, bits))
    grams = stored(_prefixes(documents, width, percent, sketch, bits), "prefixes")
    sketch.destroy()
    # Only n-grams that stand in two or more prefixes can join; counting them moves one number a row.
    shared = grams.groupBy("gram").count().where("count > 1").select("gram")
    met = grams.join(shared, "gram", "left_semi").groupBy("gram", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    met = stored(met, "met")
    # The set in which the shared n-gram comes earliest has the fewest rare n-grams, so most of a group is near it.
    centres = met.groupBy("gram").agg(F.min(F.struct("pos", "node")).alias("least"), F.count("*").alias("sets")).where("sets > 1").select("gram", F.col("least.node").alias("centre"))
    marks = sets.where("node is not null").select("node", *PARITIES).dropDuplicates(["node"])
    met = stored(met.join(centres, "gram").join(marks, "node"), "shared")
    a, b = met.where("node <> centre").alias("a"), met.where("node = centre").alias("b")
    first = stored(a.join(b, (F.col("a.gram") == F.col("b.gram")) & _may_link(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
    links = stored(_verified(first, sets, documents, width, percent), "links")
    roots = stored(connected_components(links), "roots")
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / LOT_SETS).cast("int").alias("lots")).where("low <> high").select("gram", "lots")
    placed = placed.join(apart, "gram")
    # One n-gram in very many components: one side is dealt into lots and the other meets each of them.
    a = placed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).alias("a")
    b = placed.withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int")).alias("b")
    second = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.lot") == F.col("b.lot")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_link(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    second = stored(second.join(first, ["a", "b"], "left_anti"), "pairs")
    if second.take(1):
        more = stored(_verified(second, sets, documents, width, percent), "links")
        if more.take(1):
            roots = stored(connected_components(links.union(more)), "roots")
    rows = sets.where("sketch is null").select("doc_id", "mark", "n", "node")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("rows")).join(roots, "node")
    return join_labels(rows, stored(nodes, "nodes"), "node", "rows", rows.count()).withColumn("root", F.coalesce("root", "node"))


def _groups(rows: DataFrame, what: Column) -> DataFrame:
    """``root, size, first`` of the components of two rows or more; ``first`` is the least ``what``."""
    return rows.where("root is not null").groupBy("root").agg(F.count("*").alias("size"), F.min(what).alias("first")).where("size > 1")


def ngram_components(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Links documents whose sets of distinct ``width``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Returns a row for each row: ``doc_id, n_shingles long, component_id long`` (smallest doc_id reachable by links,
    itself included). A-Z are lower-cased; words are separated by ASCII white space. Rows without words or with a
    null text have no shingles and link with nothing. Equal texts link; repeated rows and rows that share an id stay
    rows of their own. A null doc_id counts as larger than any other; a component of only such rows has a null id.
    Further columns are ignored; an empty table gives no rows.
    """
    rows = stored(_labelled(documents, width, percent), "labelled")
    groups = stored(_groups(rows, F.col("doc_id")), "groups")
    # A component without any id has a null one; rows that aren't in a group of two or more keep their own.
    out = join_labels(rows, groups.withColumn("grouped", F.lit(True)), "root", "size", rows.count())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grouped"), F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


#: The same rows by plain pairs, for DuckDB.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


def without_near_copies(documents: DataFrame, **options) -> DataFrame:
    """One row of ``documents`` for each group of linked rows, with all its columns: that of the smallest doc_id.

    Null ids count as larger than any other. Of linked rows with the smallest id that of one text stays, chosen by a
    hash of the texts; of repeated rows with that id and text one stays, chosen by a hash of its columns. All rows
    that link with nothing stay, whatever ids they share: rows with a null, an empty or a blank text, and rows of an id
    whose other rows have other texts. Columns of any name pass through; an empty table gives no rows.
    """
    width, percent = options.get("width", 4), options.get("percent", 85)
    rows = stored(_labelled(documents, width, percent), "labelled")
    total = rows.count()
    # False sorts before true, so rows with an id come first.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    groups = stored(_groups(rows, key), "groups")
    grouped = join_labels(rows.where("root is not null"), groups, "root", "size", total).where("first is not null")
    grouped = grouped.groupBy("doc_id", "mark").agg(F.count("*").alias("times"), F.first(~F.col("first").eqNullSafe(key)).alias("gone"))
    grouped = stored(grouped.where("gone or times > 1"), "copies")
    names = {k: f"veilspan {k}" for k in ("id", "mark")}
    gone = grouped.where("gone").select(F.col("doc_id").alias(names["id"]), F.col("mark").alias(names["mark"]))
    many = grouped.where("not gone").select(F.col("doc_id").alias(names["id"]), F.col("mark").alias(names["mark"]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names["id"])) & (F.xxhash64("text") == F.col(names["mark"]))
    kept = documents.join(_small(gone), same, "left_anti")
    if not many.take(1):
        return kept
    hashed = [F.col(f"`{f.name}`") for f in documents.schema if not isinstance(f.dataType, MapType)]
    again = documents.join(_small(many), same, "left_semi")
    one = again.groupBy(F.col("doc_id").alias(names["id"]), F.xxhash64("text").alias(names["mark"])).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.xxhash64(*hashed)).alias("row"))
    return kept.join(_small(many), same, "left_anti").unionByName(one.select("row.*"))


def _small(keys: DataFrame) -> DataFrame:
    """Row keys, to be broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
