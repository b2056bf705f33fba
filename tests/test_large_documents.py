"""Single documents with very many spans, actions or equal values, held against plain loops; times are bounded loosely."""

import random
import time
from bisect import bisect_left

import pytest

from veilspan.operators import consistency, intervals, merge, raster, review

RANGE = "doc_id long, start int, end int"


def brute_pairs(a, b):
    return sorted((d, s, e, x, y) for d, s, e in a for k, x, y in b if d == k and s < y and x < e)


@pytest.mark.parametrize("width", [1, 3, 256])
def test_overlaps_equal_all_comparisons(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "BIN", width)
    rng = random.Random(width)
    make = lambda n, most: [(rng.randrange(3), s, s + rng.randrange(most)) for s in (rng.randrange(60) for _ in range(n))]
    a, b = make(80, 9), make(50, 30)
    a += a[:5]
    left, right = spark.createDataFrame(a, RANGE), spark.createDataFrame(b, RANGE)
    got = sorted((r["doc_id"], *r["a"], *r["b"]) for r in intervals.pairs(left.select("start", "end", "doc_id"), right.select("start", "end", "doc_id")).collect())
    assert [(g[0], g[1], g[2], g[4], g[5]) for g in got] == brute_pairs(a, b)
    met = {(d, s, e) for d, s, e, *_ in brute_pairs(a, b)}
    assert sorted(map(tuple, intervals.apart(left, right).collect())) == sorted(x for x in a if x not in met)
    assert sorted(map(tuple, intervals.touched(left, right).collect())) == sorted(x for x in a if x in met)


def test_nulls_and_empty_tables_overlap_nothing(spark):
    a = spark.createDataFrame([(1, None, 5), (None, 0, 5), (1, 0, 5), (1, 4, 4)], RANGE)
    b = spark.createDataFrame([(None, 0, 9), (1, None, 9), (1, 3, None), (1, 4, 6)], RANGE)
    assert [tuple(r) for r in intervals.touched(a, b).collect()] == [(1, 0, 5)]
    assert intervals.apart(a, b).count() == 3 and intervals.apart(a, b.limit(0)).count() == 4 and intervals.apart(a.limit(0), b).count() == 0
    assert intervals.pairs(a, b).count() == 1


def test_boxes_and_suppression_in_a_long_page(spark):
    rng = random.Random(7)
    words, at = [], 0
    for k in range(50_000):
        size = rng.randrange(1, 9)
        words.append((1, 0, k, at, at + size, (k, 0, k + 1, 1)))
        at += size + 1
    found = sorted((1, 0, s, s + rng.randrange(1, 60)) for s in (rng.randrange(at) for _ in range(20_000)))
    placed = spark.createDataFrame(words, "doc_id long, page int, ord int, start int, end int, box struct<x0:int,y0:int,x1:int,y1:int>")
    own = spark.createDataFrame(found, "doc_id long, page int, start int, end int")
    began = time.perf_counter()
    got = sorted((r["start"], r["end"], r["ord"]) for r in raster.span_boxes(own, placed).collect())
    assert time.perf_counter() - began < 60
    starts, ends = [w[3] for w in words], [w[4] for w in words]
    want = [(s, e, k) for *_, s, e in found for k in range(bisect_left(ends, s + 1), bisect_left(starts, e))]
    assert got == sorted(want)
    ranges = placed.where("ord % 7 = 0").select("doc_id", "start", "end")
    free = sorted((r["start"], r["end"]) for r in merge.suppressed(own, ranges).collect())
    assert free == sorted((s, e) for *_, s, e in found if not any(k % 7 == 0 for k in range(bisect_left(ends, s + 1), bisect_left(starts, e))))


def test_ten_thousand_dependent_actions(spark):
    docs = spark.createDataFrame([(1, "x" * 9000)], "doc_id long, text string")
    found = spark.createDataFrame([(1, "m:0-1", 0, 1, "x", "ORG", 0.9, ["ner"], "", None, 2, [])], f"doc_id long, {review.ITEM}")
    rng = random.Random(3)
    log, stack, there, wrong, status = [], [], set(), [], {}
    for seq in range(10_000):
        kind, place = rng.choice(["add_missed", "accept", "dismiss", "undo", "accept"]), rng.randrange(400)
        name = f"manual:{place}-{place + 1}"
        log.append((1, seq, kind, name if kind in ("accept", "dismiss") else None, *((place, place + 1) if kind == "add_missed" else (None, None)), None))
        if kind == "undo":
            if not stack:
                wrong.append((seq, "nothing_to_undo"))
                continue
            what, own, before = stack.pop()
            there -= {own} if what == "add_missed" else set()
            if what == "add_missed":
                status.pop(own, None)
            elif own in there:
                status[own] = before
        elif kind == "add_missed":
            stack.append((kind, name, None))
            there.add(name)
            status[name] = "accepted"
        elif name in there:
            stack.append((kind, name, status[name]))
            status[name] = "accepted" if kind == "accept" else "dismissed"
        else:
            wrong.append((seq, "unknown_item"))
    actions = review.action_rows(spark, log)
    began = time.perf_counter()
    errors = sorted((r["seq"], r["error"]) for r in review.action_errors(docs, found, actions).collect())
    assert time.perf_counter() - began < 30
    assert errors == wrong
    items = {r["id"]: r["status"] for r in review.queue(docs, found, actions).collect()}
    assert set(items) == there | {"m:0-1"}


def test_thousands_of_equal_values_stay_linear(spark):
    n = 8000
    rows = [(1, k, 3 * k, 3 * k + 2, "ab", "EMAIL", 0.99, "regex", "", "a@b.cd") for k in range(n)]
    found = merge.merge(spark.createDataFrame(rows, "doc_id long, arrival long, start int, end int, text string, type string, confidence double, source string, reason string, normalized_value string"))
    own = found.drop("linked")
    assert "collect_list" not in own._jdf.queryExecution().optimizedPlan().toString().split("link_group")[0]
    docs = spark.createDataFrame([(1, "ab " * n)], "doc_id long, text string")
    actions = review.action_rows(spark, [(1, k, "accept" if k % 2 else "dismiss", f"m:{3 * k}-{3 * k + 2}", None, None, None) for k in range(n)] + [(1, n, "add_missed", None, 6, 8, None), (1, n + 1, "dismiss", "m:6-8", None, None, None), (1, n + 2, "add_missed", None, 9, 11, None), (1, n + 3, "dismiss", "m:0-2", None, None, None)])
    began = time.perf_counter()
    items = {r["id"]: r for r in review.queue(docs, own, actions).collect()}
    assert time.perf_counter() - began < 60
    assert len(items) == n + 2 and {r["linked_count"] for r in items.values()} == {n - 1, 0}
    assert {r["status"] for k, r in items.items() if k.startswith("m:")} == {"dismissed"} and {r["tier"] for r in items.values()} == {1}
    # The last decision on another place of the group reaches both; the one on the same place doesn't.
    assert items["manual:6-8"]["status"] == items["manual:9-11"]["status"] == "dismissed"


def test_groups_are_those_of_the_linked_places(spark):
    rows = [(1, 0, 1, [(4, 5), (8, 9)]), (1, 4, 5, [(0, 1), (8, 9)]), (1, 8, 9, [(0, 1), (4, 5)]), (1, 2, 3, [])]
    got = merge.with_groups(spark.createDataFrame(rows, "doc_id long, start int, end int, linked array<struct<start:int,end:int>>")).orderBy("start").collect()
    assert [(r["link_group"], r["linked_count"]) for r in got] == [("0-1", 2), (None, 0), ("0-1", 2), ("0-1", 2)]


def test_conflicts_come_once(spark):
    rows = [(1, 0, 900, "ORG"), (1, 300, 900, "PERSON"), (1, 890, 1000, "ADDRESS")]
    got = sorted((r["a_type"], r["b_type"]) for r in consistency.conflicts(spark.createDataFrame(rows, "doc_id long, start int, end int, type string")).collect())
    assert got == [("ADDRESS", "ORG"), ("ADDRESS", "PERSON"), ("ORG", "PERSON")]
