import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_schema_and_run_matches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen, out = docs.columns, docs.count(), docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    from linkengine.llm.common import materialize

    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, out, SF), name)
        assert out.columns[:5] == names and (i == 4 or out.columns == names)
        n = out.count()
        assert 0 < n <= seen
        seen = n
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
