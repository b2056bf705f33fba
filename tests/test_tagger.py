from itertools import product

import numpy as np
import pandas as pd
import pytest

from veilspan.operators import consistency, dictionary, merge, names, tagger
from veilspan.queries import NOTE


@pytest.fixture(scope="module")
def learnt(spark):
    return tagger.fit(tagger.lesson_sentences(spark, 3000), rounds=4)


def of(model, text):
    return [(text[e["start"] : e["end"]], e["entity"]) for e in tagger.analyser(model)(pd.Series([text]))[0]]


def test_best_paths_equal_all_paths():
    rng = np.random.default_rng(1)
    model = tagger.Tagger(rng.normal(size=(tagger.BUCKETS, len(tagger.TAGS))).astype(np.float32), rng.normal(size=(len(tagger.TAGS) + 1, len(tagger.TAGS))).astype(np.float32))
    segments = [["Ann", "met", "Bo", "9"], ["x"], ["Great", "Hall"], ["the", "Old", "Bank", "of", "X"]]
    for words, path in zip(segments, model.paths(segments), strict=True):
        scores = model.scores([words])[0]

        def total(tags, scores=scores):
            before = len(tagger.TAGS)
            out = 0.0
            for t, tag in enumerate(tags):
                out += scores[t, tag] + (model.follows[before, tag] if tagger._MAY[before, tag] else tagger._NEVER)
                before = tag
            return out

        best = max(product(range(len(tagger.TAGS)), repeat=len(words)), key=total)
        assert abs(total(best) - total(path)) < 1e-3
        assert [p.tolist() for p in model.paths([words])] == [path.tolist()]


def test_averages_are_those_of_all_steps():
    sentences = [(["Ann", "came"], [1, 0]), (["the", "Bank"], [0, 3]), (["Ann", "Lee", "left"], [1, 2, 0])]
    model = tagger.Tagger()
    total, follows = model.learn(sentences, 5)
    stepwise, seen = tagger.Tagger(), []
    import random

    order = list(range(3))
    random.Random(5).shuffle(order)
    for k in order:
        one = tagger.Tagger(stepwise.weights.copy(), stepwise.follows.copy())
        one.learn([sentences[k]], 0)
        stepwise = one
        seen.append((one.weights, one.follows))
    assert np.allclose(stepwise.weights, model.weights)
    assert np.allclose(np.mean([w for w, _ in seen], axis=0), total) and np.allclose(np.mean([f for _, f in seen], axis=0), follows)


def test_the_note_reaches_the_published_figures(spark, learnt):
    note = spark.createDataFrame([(1, NOTE)], "doc_id long, text string")
    got = names.detect_names(note, dictionary.allow_ranges(note), analyser=tagger.analyser(learnt))
    truth = [(1, k, NOTE.index(v), NOTE.index(v) + len(v)) for v, k in (("Anna Hartwell", "PERSON"), ("Martin Sorvik", "PERSON"), ("Anna has", "PERSON"), ("27 Riverbank Street, Newtown NSW 2042", "ADDRESS"))]
    scored = {r["type"]: r for r in consistency.scored(got, spark.createDataFrame(truth, "doc_id long, type string, start int, end int")).collect()}
    assert scored["PERSON"]["precision"] >= 0.75 and scored["PERSON"]["recall"] == 1.0
    assert scored["ADDRESS"]["precision"] == scored["ADDRESS"]["recall"] == 1.0
    assert all(NOTE[r["start"] : r["end"]] == r["text"] and r["reason"].startswith("the analyser") for r in got.collect())
    assert merge.merge(got).count() == got.count()


def test_held_out_lessons(spark, learnt):
    rows = tagger.lesson_sentences(spark, 400, seed=99).collect()
    right = found = true = 0
    for r, path in zip(rows, learnt.paths([list(r["tokens"]) for r in rows]), strict=True):
        want = [tagger.TAGS.index(t) for t in r["tags"]]
        right += sum(a == b != 0 for a, b in zip(path, want, strict=True))
        found += sum(a != 0 for a in path)
        true += sum(b != 0 for b in want)
    assert right / found > 0.9 and right / true > 0.9


def test_unseen_names_and_plain_text(learnt):
    assert ("Zoe", "PERSON") in of(learnt, "His wife, Zoe, works at Fernbank Credit Union Ltd.")
    assert ("4 Old Mill Road, Dunmore VIC 3021", "STREET_ADDRESS") in of(learnt, "My neighbour, John Smithson, lives at 4 Old Mill Road, Dunmore VIC 3021.")
    assert of(learnt, "nothing here begins with a capital, so there is no name") == []
    got = tagger.analyser(learnt)(pd.Series([None, "", "\n\n", "Dr. Bo Novak wrote to Mr. Lee Osei.\n\U0001f600 Dear Ann,"], index=[4, 5, 6, 9]))
    assert list(got.index) == [4, 5, 6, 9] and got[4] == got[5] == got[6] == [] and len(got[9]) == 3


def test_weights_are_kept(spark, learnt, tmp_path):
    tagger.saved(learnt, spark, f"file://{tmp_path}/model")
    again = tagger.loaded(spark, f"file://{tmp_path}/model")
    assert np.array_equal(again.weights, learnt.weights) and np.array_equal(again.follows, learnt.follows)
    assert tagger.fit(tagger.lesson_sentences(spark, 0), rounds=1).weights.any() == False  # noqa: E712


def test_plain_sentences_are_counterexamples(spark):
    docs = spark.createDataFrame([(1, "Too short\n" + "Great words stand here in a line of text\n" * 3), (2, None)], "doc_id long, text string")
    rows = tagger.plain_sentences(docs, 2).collect()
    assert len(rows) == 2 and set(rows[0]["tags"]) == {"O"} and len(rows[0]["tags"]) == len(rows[0]["tokens"]) == 9
