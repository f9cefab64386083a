"""What is planned stays small, however many rounds there are."""

from survperf.llm import queries, sharding, simhash


def test_components_plan_does_not_grow_with_rounds(spark):
    """A checkpoint's guess of its size is multiplied by each join: in a loop its digits double, in the driver."""
    edges = spark.range(200).selectExpr("id a", "id + 1 b")
    found = simhash.components(edges)
    guess = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert guess.bit_length() < 100
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 201)}


def test_op7_shuffles_whole_documents(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some text"), (2, None), (3, "some text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, shuffle = [], sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df: seen.extend(df.columns) or shuffle(df))
    rows = queries.op7_sharding(spark, str(tmp_path)).collect()
    assert "text" in seen and sorted((r.doc_id, r.size) for r in rows) == [(1, 10), (2, 1), (3, 10)]
