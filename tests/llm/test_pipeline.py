"""The pipeline's stages on a small table with a copy, a leak, a text without letters and nulls."""


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from stockroom.session import ScratchTable

    item = " ".join(f"item{chr(97 + i)}x" for i in range(20))
    texts = [" ".join(f"{chr(97 + i)}word{chr(97 + k)}" for k in range(20)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "s1", 1), (50, texts[0], "en", "s1", 1), (51, "x " + item, "en", "s0", 1), (52, "12 !!", "en", "s0", 1), (53, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = ScratchTable(stage(spark, docs, str(tmp_path)), f"test-{name}").df
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "token_files" or docs.columns == columns
    assert left[0] == {*range(12), 50, 51}
    assert left[1] == {*range(12), 51}
    assert left[2] == set(range(12))
    assert left[3] <= left[2]
    assert left[4] == left[3]
