"""How the vocabulary of each source differs from that of the others, and of the whole, of its language.

All arithmetic is on integers. A group (a language's source, or the language) gives each kept term the weight
p = 1 + floor(SCALE * (count + 1) / (N + V)), and a term tells p from q by floor((p - q)^2 / q).

The executors count terms and pass their sums on. A language's kept terms are cut into blocks by a hash; a block
becomes a dense int64 tile of groups by terms. Broadcasting rows of the tile against the whole tile gives all pairs of groups at once,
a partial matrix whose entries are summed over the blocks; a block's best terms of each group are a heap of bounded
size, and the heaps are merged. Blocks hold about as many cells whatever the table's size; no block gets a text,
and what it gets of the groups is a number for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

#: Fixed values of the contract: the scale of weights, and the bytes that terms are made of, upper case to be lowered.
SCALE = 1_000_000_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task passes its counts on when it holds so many entries; a long text is counted in pieces of about so many bytes.
HELD, PIECE = 150_000, 1 << 20
#: Cells of a tile on average, and of the temporary arrays over it.
TILE_CELLS, WORK_CELLS = 1_000_000, 500_000
COUNTS = "lang string, source string, term string, n long, df long"


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; no piece ends within a term."""
    at = 0
    while at < len(data):
        part = data[at : at + PIECE].translate(FOLD)
        at += PIECE
        while at < len(data) and part[-1] != 32:  # a term goes on, perhaps over many pieces
            more = data[at : at + PIECE].translate(FOLD)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            at += len(more) if stop < 0 else stop + 1
        yield part.split()


def terms(text: str) -> list[str]:
    """All terms of a text."""
    return [t.decode() for part in pieces(text.encode()) for t in part]


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences of each term in a group, and in how many of its rows it stands.

    Each group also has a row with a null term. Null texts, languages and sources count as empty; repeated rows count
    as often as they stand; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in counts.items():
                names = list(n)
                size = len(names) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), size), pa.repeat(pa.scalar(source), size), pa.array([None, *names], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, names)], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )
            counts.clear()

        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, df = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for part in pieces(text.as_buffer().to_pybytes()):
                    n.update(part)
                    own.update(part)
                df.update(own)
                held += len(n) - before
                if held > HELD:
                    yield from passed_on()
                    held = 0
        yield from passed_on()

    rows = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(tidy(run), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def weights(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals), exact for totals under 9 * 10^13; the scale is put in in two steps."""
    whole, rest = np.divmod(counts + 1, totals)
    first, rest = np.divmod(rest * 100_000, totals)
    return 1 + whole * SCALE + first * 10_000 + rest * 10_000 // totals


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def pair_sums(tile: np.ndarray) -> np.ndarray:
    """For all pairs (i, j) of a tile's rows the sum of apart(row i, row j) over its terms."""
    groups, size = tile.shape
    out = np.zeros((groups, groups), dtype=np.int64)
    wide = max(1, min(size, WORK_CELLS // max(1, groups)))
    for low in range(0, size, wide):
        part = tile[:, low : low + wide]
        rows = max(1, WORK_CELLS // max(1, part.size))
        for i in range(0, groups, rows):
            out[i : i + rows] += apart(part[i : i + rows, None, :], part[None, :, :]).sum(axis=2)
    return out


def heap(values: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` largest values stand, ties by name."""
    if len(values) > most:
        least = np.partition(values, len(values) - most)[len(values) - most]
        at = np.flatnonzero(values >= least)
    else:
        at = np.arange(len(values))
    order = np.lexsort((names[at], -values[at]))
    return at[order[:most]]


def source_divergence(documents: DataFrame, least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """``lang, source, part, item string, value long, rank int``: each source against the others, and its own terms.

    Terms are runs of letters A to Z, lower-cased, and of code points from 128 on; a language keeps those in at least
    ``least_documents`` of its rows. Part ``pair`` has each other source of the language, with ``apart`` summed over the kept
    terms (0 if there are none). Part ``term`` has the kept terms that the source holds and gives more weight than
    its language, with ``apart`` of the two, the first ``most_terms`` only. Ranks are by value, ties by the item's UTF-8.

    Null texts, languages and sources count as empty. Sources without terms are there too; a language with one source
    has no pairs. Repeated rows count as often as they stand, ids aren't read, further columns are ignored; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    counted = stored(term_counts(documents), "term-counts")
    sources = counted.where("term is null").select("lang", "source")
    by_term = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("places"))
    kept = stored(by_term.where(F.col("df") >= least_documents).select("lang", "term", "total", "places"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    own = kept.select("lang", F.explode("places").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n_source"))
    groups = stored(sources.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n_source", "v", "n_lang"]), "groups")
    cells = groups.groupBy("lang").agg((F.max("v") * F.count("*")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    blocks = max(1, -(-cells // TILE_CELLS))
    left = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    # Blocks without a term add nothing, so every group need only be told to one of them beside those that have terms.
    filled = left.select("lang", "block").distinct().unionByName(groups.select("lang", F.lit(0).alias("block"))).distinct()
    right = groups.join(filled, "lang").withColumnsRenamed({"lang": "group_lang", "block": "group_block"})

    def run(tile_terms: pa.Table, tile_groups: pa.Table) -> pa.Table:
        if not tile_groups.num_rows:
            return empty
        tile_groups = tile_groups.sort_by("source")
        names, n, v = tile_groups["source"].combine_chunks(), tile_groups["n_source"].to_numpy(), tile_groups["v"][0].as_py()
        tile = np.zeros((len(names), tile_terms.num_rows), dtype=np.int64)
        places = tile_terms["places"].combine_chunks()
        flat = places.flatten()
        rows, columns = pc.index_in(flat.field("source"), names).to_numpy(), np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy())
        tile[rows, columns] = flat.field("n").to_numpy()
        held = tile > 0
        made = []
        lang = tile_groups["group_lang"][0]
        if v:
            p = weights(tile, n[:, None] + v)
            sums = pair_sums(p)
            q = weights(tile_terms["total"].to_numpy(), np.full(tile_terms.num_rows, tile_groups["n_lang"][0].as_py() + v))
            words = np.array(tile_terms["term"].cast(pa.binary()).to_pylist(), dtype=object)
            for i, name in enumerate(names):
                at = np.flatnonzero(held[i] & (p[i] > q))
                values = apart(p[i, at], q[at])
                best = heap(values, words[at], most_terms)
                made.append(_rows(lang, pa.repeat(name, len(best)), "term", pa.array(words[at][best], pa.binary()).cast(pa.string()), values[best]))
        else:
            sums = np.zeros((len(names), len(names)), dtype=np.int64)
        for i, name in enumerate(names):
            others = np.delete(np.arange(len(names)), i)
            made.append(_rows(lang, pa.repeat(name, len(others)), "pair", names.take(pa.array(others)), sums[i, others]))
        return pa.Table.from_batches(made)

    layout = "lang string, source string, part string, item string, value long"
    empty = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())]).empty_table()
    partial = left.groupBy("lang", "block").cogroup(right.groupBy("group_lang", "group_block")).applyInArrow(run, layout)
    partial = stored(partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranks = [partial.where(F.col("part") == part).withColumn("rank", F.row_number().over(order)) for part in ("pair", "term")]
    return ranks[0].unionByName(ranks[1].where(F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")


def _rows(lang: pa.Scalar, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    size = len(item)
    return pa.RecordBatch.from_arrays([pa.repeat(lang, size), source, pa.repeat(pa.scalar(part), size), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM own GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(totals.n, 0) + v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 1) // (sizes.n + v) AS q
  FROM sources s JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals ON totals.lang = s.lang AND totals.source = s.source LEFT JOIN own ON own.lang = s.lang AND own.source = s.source AND own.term = k.term
),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
