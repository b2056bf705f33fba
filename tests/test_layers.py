"""The layers' report has every document, whatever its text."""

import pytest

from veilspan import queries
from veilspan.plans.detect import detect

TEXTS = [(1, "Call 0413 552 760, more than once"), (2, ""), (3, None), (4, " "), (5, "with the example.com of the day")]


@pytest.fixture
def stored(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_empty_and_null_texts_have_rows_for_all_layers(spark, stored):
    got = {(r["doc_id"], r["name"]): (r["status"], r["count"], r["detail"]) for r in queries.layer_counts(spark, stored).collect()}
    allowed = "closed-world entities; {} allowlisted range(s)".format
    counts = {1: (1, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 2, 2)}
    want = {}
    for doc_id, (regex, dictionary, ranges) in counts.items():
        want |= {(doc_id, "regex"): ("ok", regex, "structured PII (phone/email/ID)"), (doc_id, "dictionary"): ("ok", dictionary, allowed(ranges))}
        want |= {(doc_id, "ner"): ("skipped", 0, "switched off"), (doc_id, "llm"): ("skipped", 0, "disabled (offline/no key)")}
    assert got == want


def test_a_table_of_terms_leaves_no_document_out_of_the_report(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = spark.createDataFrame([(0, "example", "ORG")], "ord int, term string, type string")
    report = detect(docs, terms).layers.where("name = 'dictionary'").collect()
    assert {r["doc_id"]: r["count"] for r in report} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_every_document_is_in_the_tallies(spark, stored):
    got = sorted(tuple(r) for r in queries.layer_tally(spark, stored).collect())
    assert got == [(doc_id, 2, 2, 0) for doc_id, _ in TEXTS]
