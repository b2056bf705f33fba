import numpy as np
import pytest

from veilspan.llm.ann_multiprobe import nearest
from veilspan.llm.binary_dedup import Coded, dedup, undecided
from veilspan.llm.components import connected_components
from veilspan.llm.ngram_jaccard import linked, ngram_components, parities, suffix_bound, without_near_copies
from veilspan.llm.shingles import shingle_sets


def brute_sets(texts, width=4):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(rows, width=4, percent=85):
    sets = brute_sets([t for _, t in rows], width)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=repr)


def corpus(seed, n=220):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(words, 9))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 4)):
                if w:
                    w[rng.integers(len(w))] = str(rng.choice(words))
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(words, rng.integers(0, 60))) + (" " + passage if kind > 0.7 else ""))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_equal_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed)))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_ngram_components_of_a_large_group(spark):
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        w[(7 * k) % 120] = f"e{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, f"short line {k} then the passage all share in full") for k in range(200)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)


def test_ngram_components_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, ngram_components(odd).collect()), key=repr) == brute_components(rows)
    assert ngram_components(none).count() == 0


def test_one_row_of_each_group_stays(odd, none):
    kept = without_near_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, -1, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 13]
    assert without_near_copies(none).count() == 0


def brute_kept(rows, width, percent):
    """Row numbers that stay: of each group of linked rows one, of the least id, then of the least number."""
    sets = brute_sets([t for _, t in rows], width)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, [g for g in {label[k] for k in range(len(rows)) if sets[k]}], [k for k in range(len(rows)) if not sets[k]]


@pytest.mark.parametrize("seed", [3])
def test_each_component_keeps_one_row_and_unlinked_rows_stay(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [t or None for t in corpus(seed, 160)] + [None, "", " "]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 60)), t) for t in texts]
    rows += [rows[k] for k in rng.integers(0, len(rows), 30)]
    label, groups, wordless = brute_kept(rows, 5, 80)
    got = without_near_copies(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, root int").repartition(3), width=5, percent=80).collect()
    kept = sorted(r["root"] for r in got)
    assert all(rows[r["root"]] == (r["doc_id"], r["text"]) for r in got)
    assert sorted(label[k] for k in kept if k not in wordless) == sorted(groups) and [k for k in kept if k in wordless] == wordless
    least = {g: min((i is None, i or 0) for k, (i, _) in enumerate(rows) if label[k] == g) for g in groups}
    assert all((rows[k][0] is None, rows[k][0] or 0) == least[label[k]] for k in kept if k not in wordless)


def test_rows_that_share_an_id_but_no_text_stay(spark):
    schema = "doc_id long, text string"
    assert without_near_copies(spark.createDataFrame([(13, "one text of some words here"), (13, "another one with words of its own")], schema)).count() == 2
    got = without_near_copies(spark.createDataFrame([(1, "a a b c d e"), (2, "a a b c d e"), (2, "b is not like it at all")], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, "a a b c d e"), (2, "b is not like it at all")]


def test_shingle_sets_don_t_depend_on_the_batch():
    texts = ["a b c d e", "", "a", "A b C d e", "x " * 700_000, "é ü\x85 y z", "a\x0bb\x0cc d  e"]
    alone = [shingle_sets([t], 4)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, shingle_sets(texts, 4), strict=True))
    assert [len(x) for x in alone] == [len(s) for s in brute_sets(texts)]
    assert (alone[0] == alone[3]).all() and (alone[0] == alone[6]).all()


def test_filters_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        assert suffix_bound(x, y) <= apart
        assert sum(int(v).bit_count() for v in (parities(x) ^ parities(y)).view(np.uint64)) <= apart
        same = len(np.intersect1d(x, y))
        assert linked(x, y, 85) == (100 * same >= 85 * (len(x) + len(y) - same))


def test_connected_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (200, 200), (300, 301), (303, 302), (302, 301)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 300, 301: 300, 302: 300, 303: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(seed, n=900, width=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for k in range(150):
        x[n - 1 - k] = x[k % 40] * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.uniform(0.05, 0.4)
    x[200:260] = x[200] + rng.normal(size=(60, width)) * 0.05
    return x


ODD_VECTORS = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [float("inf")] + [1.0] * 23), (5004, [None] + [1.0] * 23), (5005, []), (None, None)]


def test_dedup_equals_all_pairs(spark):
    x = planted(5).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + ODD_VECTORS
    got = dedup(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3), chunk_rows=256)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        low = np.array([min([root[k], *root[link[k]]]) for k in range(len(x))])
        if (low == root).all():
            break
        root = low
    want = [(k, int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))] + [(i, 0, i, True) for i, _ in ODD_VECTORS]
    assert link.sum() > 1000
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_dedup_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert dedup(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in dedup(spark.createDataFrame(ODD_VECTORS[:1], kind)).collect()] == [(5000, 0, 5000, True)]
    twice = dedup(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])], kind)).collect()
    assert sorted(map(tuple, twice)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_very_large_and_very_small_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    got = dedup(spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 1e-201]), (4, [0.0, 5e-324]), (5, [0.0, 1e308])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    near = nearest(spark.createDataFrame([(20, [1e-200, 0.0]), (3, [1e-200, 1e-200]), (2, [3e-200, 0.0]), (40, [1e200, 1e200])], kind)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in near) == [(20, 1, 40), (20, 2, 2), (20, 3, 3), (40, 1, 2), (40, 2, 3), (40, 3, 20)]


@pytest.mark.parametrize("width", [7, 64, 130])
def test_codes_rule_out_no_pair_that_links(width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(600, width))
    x[300:] = x[:300] + rng.normal(size=(300, width)) * rng.uniform(0, 0.6, size=(300, 1))
    c = Coded(x)
    side = (c.codes(), c.factors, *c.planes())
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    in_a, in_b = undecided(side, side, width, 0.95, True)
    assert link.any() and not (link.any(axis=1) & ~in_a).any() and not (link.any(axis=0) & ~in_b).any()
    if width >= 64:  # of unrelated vectors few are undecided
        c = Coded(rng.normal(size=(600, width)))
        side = (c.codes(), c.factors, *c.planes())
        assert undecided(side, side, width, 0.95, True)[0].mean() < 0.1


def test_code_estimates_are_bounded_and_unbiased():
    rng = np.random.default_rng(2)
    c = Coded(rng.normal(size=(1500, 64)))
    estimates = (c.rotated @ c.signs.T) / c.factors
    true = c.rotated @ c.rotated.T
    f = c.factors.astype(np.float64)
    slack = np.sqrt(np.maximum(0, 1 - true.astype(np.float64) ** 2)) * np.sqrt(1 - f * f) / f
    assert (np.abs(estimates - true) <= slack + 1e-3).all()
    off = ~np.eye(len(f), dtype=bool)
    assert abs((estimates - true)[off].mean()) < 1e-3


@pytest.mark.parametrize("scaled", [False, True])
def test_search_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:160] = x[100] + rng.normal(size=(60, 32)) * 0.01
    if scaled:
        x *= rng.uniform(0.5, 1.5, size=(len(x), 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (None, [1.0] * 32)]
    got = nearest(spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)).toPandas()
    asked = np.arange(0, 3000, 20)
    assert sorted(set(got.query_id)) == asked.tolist()
    hits = 0
    for q in asked:
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        score = x @ x[q]
        assert np.abs(own.score.to_numpy() - score[own.vec_id]).max() < 1e-12
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert hits / (20 * len(asked)) >= 0.9


def test_search_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert nearest(spark.createDataFrame([], kind)).count() == 0
    assert nearest(spark.createDataFrame([(20, None)], kind)).count() == 0
    got = nearest(spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [2.0, 0.0])], kind)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 20, 2.0), (20, 1, 20, 2.0), (20, 2, 2, 0.5), (20, 2, 2, 1.0), (20, 3, 3, 0.5), (20, 3, 3, 1.0)]
