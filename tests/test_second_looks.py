from veilspan.operators import consistency, merge
from veilspan.sources.models import Replies


def test_lenses_are_joined_and_the_model_only_asks_for_review(spark):
    text = "Anna Lee wrote. Later anna came to her doctor, Raymond Pike; see 10.0.0.1 or https://x.org/anna today."
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, "")], "doc_id long, text string")
    hidden = spark.createDataFrame([(1, 0, 8, "Anna Lee", 0.9), (2, 0, 3, "not", 0.5)], "doc_id long, start int, end int, text string, confidence double")
    client = Replies({"doctor": '{"entities": [{"text": "Raymond Pike", "type": "PERSON"}, {"text": "Anna Lee"}, {"text": "10.0.0.1 or"}]}'})
    got = [(r["doc_id"], r["ord"], r["text"], r["lenses"], r["severity"]) for r in consistency.second_looks(docs, hidden, client).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 1, "anna", ["consistency"], "suggest"), (1, 2, "https://x.org/anna", ["consistency", "format"], "suggest"), (1, 3, "10.0.0.1 or", ["format", "semantic"], "suggest"), (1, 4, "Raymond Pike", ["semantic"], "review"),
    ]
    assert {r["text"] for r in consistency.second_looks(docs, hidden).collect()} == {"anna", "https://x.org/anna", "10.0.0.1"}
    assert consistency.second_looks(docs.limit(0), hidden.limit(0), client).count() == 0


def test_offsets_of_all_that_overlaps(spark):
    text = "0123456789" * 3
    rows = [(1, 0, 2, 7, text[2:7], "ORG", 0.99, "regex", "a", "v"), (1, 1, 5, 12, text[5:12], "PERSON", 0.8, "ner", "b", None), (1, 2, 11, 14, text[11:14], "ORG", 0.55, "llm", "c", None), (1, 3, 14, 20, text[14:20], "ORG", 0.99, "regex", "d", "v")]
    found = spark.createDataFrame(rows, "doc_id long, arrival long, start int, end int, text string, type string, confidence double, source string, reason string, normalized_value string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    wide = merge.merge(found, whole=docs).orderBy("start").collect()
    assert [(r["id"], r["text"], r["type"], r["sources"]) for r in wide] == [("m:2-14", text[2:14], "ORG", ["llm", "ner", "regex"]), ("m:14-20", text[14:20], "ORG", ["regex"])]
    assert [[tuple(x) for x in r["linked"]] for r in wide] == [[(14, 20)], [(2, 14)]]
    assert [r["id"] for r in merge.merge(found).orderBy("start").collect()] == ["m:2-7", "m:14-20"]
