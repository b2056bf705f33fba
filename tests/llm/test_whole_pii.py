import pytest

from veilspan.llm import pii_terms


def test_disclosing_terms_go_everywhere_in_documents_of_their_entity(spark):
    filler = [f"plain text number {k} about nothing in particular with other words" for k in range(60)]
    long = "and then a good many quite common words stand between the two so that it is far away"
    texts = [*filler, f"please write to Quentin Zarro at q.zarro@mail.org today {long} Zarro", "the old letter by Zarro names q.zarro@mail.org again", "ask Zarro or q.zarro@mail.org then", f"q.zarro@mail.org {long} but ZARRO came"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii_terms.sanitise(d).collect()}
    assert pii_terms.sanitise(d).count() == len(texts)
    assert [clean[k] for k in range(60)] == filler
    assert not any("zarro" in t.lower() for t in clean.values())
    assert clean[60].endswith("far away [NAME]") and clean[63].endswith("but [NAME] came")


@pytest.mark.parametrize("times", [2, 3, 10])
def test_repeating_all_rows_changes_no_span(spark, times):
    filler = [f"plain text number {k} about nothing" for k in range(6)]
    texts = [*filler, "please write to Quentin Zarro at q.zarro@mail.org today", "the old letter by Zarro names q.zarro@mail.org again", "then Zarro came, q.zarro@mail.org and q.zarro@mail.org too"]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    again = spark.createDataFrame(list(enumerate(texts)) * times, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, pii_terms.personal_data(once).collect()))
    assert sum("term:" in r[-1] for r in want) == 3
    assert sorted(map(tuple, pii_terms.personal_data(again).collect())) == sorted(want * times)
    assert not any("Zarro" in r["text"] for r in pii_terms.sanitise(again).collect())


def test_copies_of_one_passage_disclose_nothing_however_often(spark):
    texts = [f"plain text number {k} about nothing" for k in range(20)] + ["ask Zarro at q.zarro@mail.org"] * 5
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any("term:" in r["spans"] for r in pii_terms.personal_data(d).collect())
    assert tuple(pii_terms.unjudged(pii_terms.scan(d, 5)).first()) == (1, 0)
