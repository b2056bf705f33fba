import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import divergence, filter_audit, sharding

LABELS = "doc_id long, quality int, toxic int, part string, mask int, n long, good int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, None, 1), (9, 1, None), (9, 0, 1), (13, 1, 0), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], LABELS)


# Filter interaction audit


def failures(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text) is not None, copy]
    return {x for x, bad in zip("ABCDE", fails, strict=True) if bad}


def audited(rows, labels):
    """The contract's table, order by order."""
    least, good, toxic = {}, defaultdict(int), defaultdict(int)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = good[i] | (q == 1), toxic[i] | (t == 1)
    parts = defaultdict(list)
    for i, text, part in rows:
        fails = failures(text or "", i is not None and i > least[text or ""])
        parts[part or ""].append((fails, good.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0))
    out = []
    for part, docs in parts.items():
        made, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, x in enumerate(order):
                gone, stay = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                failing = sum(x in d[0] for d in docs)
                made.append(("".join(order), k + 1, len(stay), len(gone), failing - len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), x))
                shapley[x] += len(gone)
                left = stay
        out += [(part, *m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out, key=repr)


def test_filter_audit_of_odd_rows(odd, none, labels):
    got = filter_audit.filter_audit(odd, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert rows_of(got) == audited(rows, [tuple(r)[:3] for r in labels.collect()])
    assert filter_audit.filter_audit(none, labels).count() == 0
    unlabelled = filter_audit.filter_audit(odd, labels.limit(0))
    assert unlabelled.count() == 600 and unlabelled.where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_by_parts_with_copies_across_them(spark, labels):
    varied = " ".join(f"w{k}" for k in range(60))
    texts = [varied, varied + " #", " ".join(["same"] * 60), "ALL CAPITALS", "", None, varied.upper(), "\x0b\x0c\t" + "a " * 49, " b" * 50, "naïve É É É", "Ab cd ef gh ij kl mn op qr st"]
    rows = [(k, texts[(k * 7) % len(texts)], [None, "", "x", "y"][k % 4]) for k in range(60)] + [(None, varied, "x"), (5, varied, "x"), (5, varied, "x"), (-3, varied, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert rows_of(filter_audit.filter_audit(docs, labels)) == audited(rows, [tuple(r)[:3] for r in labels.collect()])


def test_filter_cells_don_t_depend_on_the_order(spark):
    docs = spark.createDataFrame([(k, f"{'word ' * (k % 70)}{'#' * (k % 3 == 0)}{'X' * (k % 5)}", "s") for k in range(200)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(k, k % 2, k % 3) for k in range(200)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, marks).collect()
    last = {r["kept"] for r in got if r["step"] == 5}
    assert len(last) == 1 and len(got) == 600
    for order in {r["filter_order"] for r in got}:
        own = [r for r in got if r["filter_order"] == order]
        assert sum(r["removed"] for r in own) + last.copy().pop() == 200
    # The shares of the five filters add up to what all of them remove, in each of the 120 orders.
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}.values()) == 120 * (200 - last.pop())


# Source divergence audit


def diverged(rows, least=3, most=200):
    """The contract's table by big integers."""
    def found(text):
        return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    rows = [(lang or "", source or "", found(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for *_, words in own for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = defaultdict(Counter)
        for _, source, words in own:
            count[source].update(t for t in words if df[t] >= least)
            count[None].update(t for t in words if df[t] >= least)
        p = {g: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for g, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for g in p:
            if g is None:
                continue
            pairs = [(h, sum(f(p[g][t], p[h][t]) for t in kept)) for h in p if h not in (None, g)]
            terms = [(t, f(p[g][t], p[None][t])) for t in kept if count[g][t] and p[g][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < most]
    return sorted(out, key=repr)


ODD_TEXTS = ["The THE the Ünïcode straße ÉCOLE", "the cat-sat on_the mat 42 ünïcode", None, "", "漢字 漢字 the É é", "a\x00b the\x7fcat é\x85x", "zz " * 300 + "the", "cat mat straße école the 漢字"]


def sourced(spark, n=120):
    rows = [([None, "", "en", "en", "de"][k % 5], [None, "", "s1", "s2", "s3", "s4", "é"][(k * k) % 7], ODD_TEXTS[k % 8] if k % 11 else f"only{k} here") for k in range(n)]
    rows += [("fr", "lone", "mot mot"), ("xx", "a", "solo words"), ("xx", "b", None), *[("en", "s1", "copy of a row")] * 4]
    return rows, spark.createDataFrame([(*r, 7, 8, 9, "t", 1) for r in rows], "lang string, source string, text string, n long, df int, block int, term string, places int").repartition(3)


@pytest.mark.parametrize("cells", [divergence.TILE_CELLS, 20])
def test_divergence_equals_big_integers(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "TILE_CELLS", cells)
    rows, docs = sourced(spark)
    assert rows_of(divergence.source_divergence(docs)) == diverged(rows)
    assert rows_of(divergence.source_divergence(docs, least_documents=1, most_terms=2)) == diverged(rows, 1, 2)


def test_divergence_of_odd_rows(odd, none):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert rows_of(divergence.source_divergence(odd, least_documents=1)) == diverged(rows, 1)
    assert divergence.source_divergence(none).count() == 0


def test_terms_are_whole_across_pieces(monkeypatch):
    text = "Aé" * 40 + " x1y " + "b" * 100 + "-" + "c " * 50 + "漢字" * 33
    whole = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.replace("A", "a"))
    for size in (1, 3, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert divergence.terms(text) == whole
    assert divergence.terms("") == []


def test_weights_are_exact_for_large_counts():
    rng = np.random.default_rng(3)
    totals = rng.integers(1, 9 * 10**13, 500)
    counts = (totals * rng.random(500)).astype(np.int64) - 1
    assert divergence.weights(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_pair_sums_in_narrow_strips(monkeypatch):
    tile = np.random.default_rng(4).integers(1, 10**9, (9, 70))
    want = [[sum(int(a - b) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in tile] for x in tile]
    for work in (1, 13, 100, 10**6):
        monkeypatch.setattr(divergence, "WORK_CELLS", work)
        assert divergence.pair_sums(tile).tolist() == want


# Sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def check_places(rows, got, shards):
    told = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == told
    slots = defaultdict(list)
    for r in got:
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", jump(key_of(r["doc_id"]), shards), jump(key_of(r["doc_id"]), shards + 1))
        assert r["grown_shard"] in (r["shard"], shards)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_places_of_odd_rows(odd, none):
    got = sharding.assignments(odd)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_places([(r["doc_id"], r["text"]) for r in odd.collect()], got.collect(), 40)
    assert sharding.assignments(none).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 7, 1000])
def test_keys_jump_as_published(spark, shards):
    ids = [*range(-50, 250), 2**63 - 1, -(2**63), *(10**12 * k for k in range(50))]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sharding.jump_shard(sharding.id_key(F.col("doc_id")), shards).alias("p")).collect()
    assert [(r["doc_id"], r["p"]["shard"], r["p"]["grown"]) for r in got] == [(i, jump(key_of(i), shards), jump(key_of(i), shards + 1)) for i in ids]


def test_keys_that_jump_often_go_on(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 2)
    got = spark.range(300).select("id", sharding.jump_shard(sharding.id_key(F.col("id")), 64)["shard"].alias("shard")).collect()
    assert [r["shard"] for r in got] == [jump(key_of(r["id"]), 64) for r in got]


def test_shards_are_even_and_growing_moves_a_share(spark):
    got = spark.range(20000).select(sharding.jump_shard(sharding.id_key(F.col("id")), 40).alias("p")).groupBy("p.shard", "p.grown").count().collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["count"]
    assert len(sizes) == 40 and all(abs(n - 500) < 6 * math.sqrt(500) for n in sizes.values())
    assert abs(sum(r["count"] for r in got if r["grown"] != r["shard"]) - 20000 / 41) < 6 * math.sqrt(20000 / 41)


def test_slots_over_ranges_and_lots_of_equal_rows(spark, monkeypatch):
    rows = [(k % 90, f"text {k % 200}") for k in range(900)] + [(3, "again")] * 500 + [(3, f"other {k}") for k in range(200)] + [(None, None)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = rows_of(sharding.assignments(docs, 6))
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    got = sharding.assignments(docs.repartition(2), 6)
    assert rows_of(got) == whole
    monkeypatch.setattr(sharding, "LOT_ROWS", 7)
    check_places(rows, sharding.assignments(docs, 6).collect(), 6)


def test_written_shards_hold_all_rows(odd, none, tmp_path):
    back = sharding.write_shards(odd, f"file://{tmp_path}/all", shards=5, parts=2)
    assert rows_of(back.drop("shard").select(odd.columns)) == rows_of(odd)
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], jump(key_of(r["doc_id"]), 5)) for r in odd.collect()}
    assert sharding.write_shards(none, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        sharding.assignments(odd, 0)
