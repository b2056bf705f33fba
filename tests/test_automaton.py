"""Terms found by automata, against one pattern for each term."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan.functions import scalars
from veilspan.operators import automaton, dictionary, render

TEXTS = [
    "Ann and ANN, not Annabel; éann ann's a.b A.B", "", None, "ann ann ann", "x (Ltd) y", "STRASSE straße ẞ", "İstanbul ISTANBUL ıstanbul istanbul", "Ünïcode ÜNÏCODE ünicode", "a_b a-b a‍b Ⓐ ⓐ \U0001f130x", "K k K ſ s S",
    "the cat sat on the mat; THE CAT", "aa aa aa", "漢字 漢 字", "\U0001f600 ann \U0001f600ann", "12 ann12 12ann 1 2", "ǅ ǆ Ǆ", "σ ς Σ",
]
TERMS = ["ann", "Ann", "a.b", "ann ann", "(ltd)", "straße", "STRASSE", "istanbul", "ISTANBUL", "ünïcode", "a_b", "a", "ⓐ", "k", "s", "the cat", "the", "cat sat on", "aa aa", "漢字", "漢", "ann12", "12", "ǆ", "σ", "", "  "]


def of(df):
    return sorted(map(tuple, df.select("doc_id", "start", "end", "text", "type").collect()), key=repr)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("chars", [dictionary.AUTOMATON_CHARS, 20])
def test_automata_find_what_patterns_find(spark, monkeypatch, chars):
    docs = table(spark, TEXTS)
    known = [(t, ["PERSON", "ORG"][k % 2]) for k, t in enumerate(TERMS)]
    inline = dictionary.detect_known(docs, known)
    monkeypatch.setattr(dictionary, "AUTOMATON_CHARS", chars)
    named = spark.createDataFrame([(k, t, kind) for k, (t, kind) in enumerate(known)], "ord int, term string, type string")
    assert dictionary.scanned_terms(docs, named) is not None
    got = dictionary.detect_known(docs, named)
    assert of(got) == of(inline) and len(of(inline)) > 40
    order = lambda df: [tuple(r) for r in df.select("doc_id", "start", "end", "type").orderBy("doc_id", "arrival").collect()]
    assert order(got) == order(inline)


def test_no_terms_no_texts_and_more_terms_than_automata_take(spark, monkeypatch):
    docs = table(spark, TEXTS)
    named = spark.createDataFrame([(k, t, "ORG") for k, t in enumerate(TERMS)] + [(99, None, "ORG")], "ord int, term string, type string")
    assert dictionary.detect_known(docs, named.limit(0)).count() == 0 and dictionary.detect_known(docs.limit(0), named).count() == 0
    few = named.where(F.col("term").rlike("^[a-z ]+$"))
    want = of(dictionary.detect_known(docs, few))
    monkeypatch.setattr(dictionary, "AUTOMATON_CHARS", 1)
    assert dictionary.scanned_terms(docs, few) is None and of(dictionary.detect_known(docs, few)) == want


def test_folding_keeps_lengths():
    every = "".join(chr(k) for k in range(0x3000) if not 0xD800 <= k <= 0xDFFF)
    assert len(automaton.folded(every)) == len(every) and automaton.folded("STRA\u00dfE K\u212a\u017f") == "stra\u00dfe kks"


def test_columns_fold_as_python_does(spark):
    points = [chr(k) for k in range(0x20000) if not 0xD800 <= k <= 0xDFFF and not 0xE000 <= k <= 0xF8FF and unicodedata.category(chr(k)) != "Cn"]
    words = ["Straße", "STRASSE", "strasse", "ΣΑΣ", "σας", "İı", "\ufb01n FIN", "ǅ", "\u212a"]
    rows = spark.createDataFrame([(p,) for p in points + words], "t string").select("t", scalars.point_folded("t").alias("simple"), scalars.casefolded("t").alias("full")).collect()
    assert [r["t"] for r in rows if r["simple"] != automaton.folded(r["t"])] == []
    cherokee = lambda t: "\u13a0" <= t <= "\u13fd" or "\uab70" <= t <= "\uabbf"
    assert [r["t"] for r in rows if r["full"] != r["t"].casefold() and not cherokee(r["t"])] == []


def test_spellings_with_sharp_s_share_a_token(spark):
    rows = [(1, 0, 6, "Straße", "ADDRESS", None), (1, 8, 15, "STRASSE", "ADDRESS", None), (1, 20, 23, "Ort", "ADDRESS", None)]
    own = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, type string, normalized_value string")
    assert [r["token"] for r in render.tokens(own, "ANONYMIZE").orderBy("start").collect()] == ["[ADDRESS_1]", "[ADDRESS_1]", "[ADDRESS_2]"]


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 6)))
    terms = list({f"{word()} {word()}" if k % 3 else word() for k in range(130_000)})[:100_000]
    texts = [" ".join(word() for _ in range(400)) for _ in range(200)]
    docs = table(spark, texts)
    named = spark.createDataFrame([(k, t, "ORG") for k, t in enumerate(terms)], "ord int, term string, type string")
    began = time.perf_counter()
    got = sorted((r["doc_id"], r["start"], r["text"]) for r in dictionary.detect_known(docs, named).collect())
    assert time.perf_counter() - began < 90
    known, want = set(terms), []
    for i, t in enumerate(texts):
        at, words = 0, t.split(" ")
        last: dict = {}
        for k, w in enumerate(words):
            for own in [w] + ([f"{w} {words[k + 1]}"] if k + 1 < len(words) else []):
                if own in known and last.get(own, 0) <= at:
                    want.append((i, at, own))
                    last[own] = at + len(own)
            at += len(w) + 1
    assert got == sorted(want) and len(want) > 1000
