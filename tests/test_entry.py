import __spark_entry__ as entry


def test_queries_and_sql_are_registered():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"regex_layer", "tiered_findings", "anonymize_text"} <= names


def test_flagship_finds_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["doc_id", "id", "start", "end", "text", "type", "confidence", "sources", "reason", "normalized_value", "tier", "linked"] and frame.count() > 0
