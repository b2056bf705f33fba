"""Searches whose rows fill several chunks and whose queries several lots, against all products."""

import numpy as np
import pytest

from veilspan.llm import ann_multiprobe


@pytest.mark.parametrize("parts", [128, 7])
def test_recall_over_chunks_and_lots(spark, monkeypatch, parts):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 2400)] + 0.35 * rng.normal(size=(2400, 24))
    x[::7] = rng.normal(size=(len(x[::7]), 24))  # scattered ones among the clusters
    monkeypatch.setattr(ann_multiprobe, "CHUNK_ROWS", 700)
    monkeypatch.setattr(ann_multiprobe, "QUERY_ROWS", 50)
    monkeypatch.setattr(ann_multiprobe, "PART_QUERIES", parts)
    got = ann_multiprobe.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).toPandas()
    asked, recall = np.arange(0, 2400, 20), []
    assert sorted(set(got.query_id)) == asked.tolist() and len(got) == 20 * len(asked)
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        assert q not in set(own.vec_id) and np.abs(own.score.to_numpy() - score[own.vec_id]).max() < 1e-9
        score[q] = -np.inf
        recall.append(len(set(np.argsort(-score)[:20]) & set(own.vec_id)) / 20)
    assert np.mean(recall) >= 0.9


def test_only_candidates_are_multiplied():
    """On vectors in tight groups few are met, and no others are ranked."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(3000, 16))
    largest = ann_multiprobe.largest_norm(x)
    hashes = ann_multiprobe.fit(x[rng.permutation(3000)[:1000]], largest, 3000, 20, 0.95)
    keys = np.arange(3000)
    q, v, score, met = ann_multiprobe.search(hashes, x, keys, keys, x[::30], keys[::30], largest, 20)
    assert met < 0.5 * 3000 * 100
    exact = x[::30] @ x.T
    exact[np.arange(100), keys[::30]] = -np.inf
    best = np.sort(exact, axis=1)[:, -20:]
    hits = sum(np.isin(np.round(score[q == k], 9), np.round(best[k], 9)).sum() for k in range(100))
    assert hits >= 0.9 * 2000
