import corpus_pipeline


def test_pipeline_drops_near_copies_by_five_words_and_80_percent(spark):
    base = [f"b{k}" for k in range(200)]
    texts = [base, [*base, *(f"c{k}" for k in range(40))], [*base, *(f"d{k}" for k in range(60))]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]
