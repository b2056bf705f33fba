import corpus_pipeline


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
