import corpus_pipeline


def test_no_documents_and_no_labels_pass_through_all_stages(spark, odd, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
