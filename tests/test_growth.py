"""What must not grow faster than the tables: how often texts and models are read, and which rows are exchanged."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.operators import consistency, dictionary, model_layer, raster, tagger
from veilspan.plans.detect import detect


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Counting:
    """A client that notes each call in a file."""

    def __init__(self, path):
        self.path = str(path)

    def complete(self, *, system, user):
        with open(self.path, "a") as out:
            out.write("x")
        return '{"entities": [{"text": "Bo Li", "type": "PERSON", "reason": "boss"}]}'


@pytest.mark.parametrize("automata", [0, 8])
def test_terms_whose_words_stand_nowhere_are_not_searched(spark, monkeypatch, automata):
    docs = spark.createDataFrame([(1, "Seen: customer#00017, Customer#00018x and the Blue ring; ring blue."), (2, "customer 00019 #00020"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(k, f"customer#{k:05d}", "ORG") for k in range(400)] + [(900, "blue ring", "ORG"), (901, "#", "ORG"), (902, None, "ORG")], "ord int, term string, type string")
    monkeypatch.setattr(dictionary, "HOT_TERMS", 50)
    kept = {r["term"]: (r["word"], r["lead"]) for r in dictionary.occurring(docs, terms).collect()}
    assert set(kept) == {"customer#00017", "customer#00019", "customer#00020", "blue ring", "#"}
    assert kept["customer#00017"] == ("00017", 9) and kept["#"] == (None, None)
    monkeypatch.setattr(dictionary, "AUTOMATON_CHARS", 200)
    monkeypatch.setattr(dictionary, "AUTOMATA", automata)
    found = dictionary.detect_known(docs, terms.where("ord <> 901"))
    assert sorted((r["doc_id"], r["start"], r["text"]) for r in found.collect()) == [(1, 6, "customer#00017"), (1, 46, "Blue ring")]


def test_words_are_held_against_hidden_parts_where_the_text_is(spark):
    many = " ".join(f"word{k}" for k in range(500))
    docs = spark.createDataFrame([(1, f"{many} WORD7 other word499"), (2, "word7 stays")], "doc_id long, text string")
    hidden = spark.createDataFrame([(1, 0, len(many), many, 0.99)], "doc_id long, start int, end int, text string, confidence double")
    found = consistency.leaked_parts(docs, hidden)
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(1, "WORD7"), (1, "word499")]
    assert ", part#" not in "".join(x for x in plan(found).splitlines() if "hashpartitioning" in x)


def test_only_words_near_spans_are_dealt_by_bin(spark):
    words = spark.createDataFrame([(1, k % 2, k, 10 * k, 10 * k + 9) for k in range(1000)], "doc_id long, page int, ord int, start int, end int").withColumn("box", F.struct("ord"))
    spans = spark.createDataFrame([(1, 0, 5000, 5025), (1, 1, 40, 40)], "doc_id long, page int, start int, end int")
    found = raster.span_boxes(spans, words)
    assert sorted(r["ord"] for r in found.collect()) == [500, 502]
    assert "arrays_overlap" in plan(found)


def test_a_tagger_reads_each_word_and_line_once(monkeypatch):
    met = []
    own = tagger.word_features
    monkeypatch.setattr(tagger, "word_features", lambda w: met.append(w) or own(w))
    run = tagger.analyser(tagger.Tagger())
    run(pd.Series(["Anna met Bob.\nAnna met Bob.", None, "Anna met Bob."]))
    run(pd.Series(["Bob met Anna."]))
    assert sorted(met) == ["", ".", "Anna", "Bob", "met"]
    assert tagger.word_features("Ann-1") == [x for place in (-1, 0, 1) for x in tagger.features("Ann-1", place)]


def test_a_model_is_asked_once_a_window(spark, tmp_path):
    texts = ["Her manager, Bo Li, called 0413 552 760.", "The doctor said so to Bo Li. " * 60, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    windows = model_layer.gated(model_layer.text_windows(docs)).count()
    found = detect(docs, client=Counting(tmp_path / "calls")).findings
    assert {(r["doc_id"], r["text"]) for r in found.where(F.array_contains("sources", "llm")).collect()} == {(1, "Bo Li")}  # the first is covered by the name layer
    assert len((tmp_path / "calls").read_text()) == windows
    replied = model_layer.asked(model_layer.gated(model_layer.text_windows(docs)), Counting(tmp_path / "more"))
    assert model_layer.detect_with_model(docs, replies=replied).count() == 4 and len((tmp_path / "more").read_text()) == windows


def test_cue_words_match_as_a_plain_list_does(spark):
    plain = r"(?iuU)\b(?:" + "|".join(model_layer.TRIGGERS) + r")\b"
    texts = [f"{a}{w}{b}" for t in model_layer.TRIGGERS for w in (t, t.upper(), t.replace("s", "ſ").replace("k", "K")) for a in ("", "x", "é ", "-", "_") for b in ("", "s", " é", "'", "́")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(plain).alias("a"), F.col("t").rlike(model_layer.TRIGGER).alias("b"))
    assert rows.where("a <> b").count() == 0 and rows.where("a").count() > 300


def test_what_is_kept_serves_findings_and_layers(spark):
    docs = spark.createDataFrame([(1, "Call 0413 552 760.")], "doc_id long, text string")
    d = detect(docs, names=False, keep=True)
    assert "InMemoryTableScan" in plan(d.findings) and "InMemoryTableScan" in plan(d.layers) and d.findings.count() == 1
