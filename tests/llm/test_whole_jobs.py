"""Results that hold for the whole table, where bounds of memory are reached."""

import numpy as np
from test_models import fold, plain_ppm

from veilspan.llm import ppm
from veilspan.llm.ann_multiprobe import nearest


def test_all_grams_of_the_training_texts_count(spark, monkeypatch):
    for bound in ("TRIE_GRAMS", "FREQUENT_WINDOWS", "SHARD_WINDOWS"):
        monkeypatch.setattr(ppm, bound, 60, raising=False)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(60)]
    got = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    training = [t.encode() for k, t in enumerate(texts) if fold(k) % 10]
    assert 0 < len(training) < len(texts)
    assert np.allclose([got[k] for k in range(len(texts))], [plain_ppm(training, t.encode()) for t in texts], atol=1e-3)


def test_a_dominant_context_is_dealt_out_and_scores_stay(spark, monkeypatch):
    for bound in ("FREQUENT_WINDOWS", "FREQUENT_WORDS"):
        monkeypatch.setattr(ppm, bound, 40)
    monkeypatch.setattr(ppm, "SHARD_WINDOWS", 160)
    rng = np.random.default_rng(14)
    letter = lambda: "abcdefghijklm"[rng.integers(13)]
    texts = ["".join(f"{letter()}{letter()}{letter()}the{letter()}" for _ in range(rng.integers(1, 40))) + " tail" * (k % 3) for k in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ppm.score(documents).collect()}
    training = [t.encode() for k, t in enumerate(texts) if fold(k) % 10]
    assert np.allclose([got[k]["score"] for k in range(len(texts))], [plain_ppm(training, t.encode()) for t in texts], atol=1e-3)
    known = {w for t in training for w in t.split()}
    assert [got[k]["n_known"] for k in range(len(texts))] == [sum(w in known for w in t.encode().split()) + 1 for t in texts]

    codes = np.unique(np.concatenate([c for c, _ in ppm.windows([t.encode() for t in texts])]))
    the = int.from_bytes(b"the", "big")
    assert np.mean((codes >> np.uint64(8)) & np.uint64(0xFFFFFF) == the) > 0.1
    grams = spark.createDataFrame([(int(c), 1, 1) for c in codes], "key long, n long, m long")
    rows = ppm._sharded(grams).toPandas()
    own = rows[~rows["sent"]]
    assert sorted(own["key"]) == sorted(codes.tolist()) and own["depth"].max() > ppm.LOW and rows["sent"].any()
    assert own.groupby("shard").size().max() <= 2 * ppm.SHARD_WINDOWS
    assert not rows[rows["sent"]].duplicated(["shard", "depth", "key"]).any()


def test_scattered_vectors_beside_tight_groups_find_their_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([np.repeat(centres, 30, axis=0) + rng.normal(size=(1200, 24)) * 0.001, rng.normal(size=(400, 24))])
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]
    got = {}
    for r in nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = range(0, len(x), 20)
    found = []
    for q in asked:
        product = x @ x[q]
        product[q] = -np.inf
        found.append(len(got.get(q, set()) & set(np.argsort(-product)[:20].tolist())) / 20)
        assert len(got.get(q, ())) == 20
    assert np.mean(found) > 0.93 and min(found) > 0.5
