from tessarine.streaming import counters


def drain(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_running_counts_and_ranks(spark, tmp_path):
    rows = [("a", "r", "b"), ("a", "r", "b"), ("b", "s", "c")]
    spark.createDataFrame(rows, "h string, r string, t string").write.parquet(f"file://{tmp_path}/kg")
    stream = spark.readStream.schema("h string, r string, t string").parquet(f"file://{tmp_path}/kg")
    assert {tuple(r) for r in drain(counters.relation_counts(stream), "complete", "counts").collect()} == {("r", 2), ("s", 1)}
    spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 1.0), (2, 9.0)], "query int, score double").write.parquet(f"file://{tmp_path}/scores")
    scores = spark.readStream.schema("query int, score double").parquet(f"file://{tmp_path}/scores")
    true = spark.createDataFrame([(1, 1.0), (2, 1.0)], "query int, true double")
    got = {r["query"]: (r.optimistic, r.pessimistic, r.realistic, r.options) for r in drain(counters.running_ranks(scores, true), "complete", "ranks").collect()}
    assert got == {1: (2, 3, 2.5, 3), 2: (2, 2, 2.0, 1)}


def test_duplicates_within_a_watermark(spark, tmp_path):
    from datetime import datetime

    rows = [("a", "r", "b", datetime(2024, 1, 1)), ("a", "r", "b", datetime(2024, 1, 1, 0, 1)), ("b", "r", "c", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "h string, r string, t string, ts timestamp").write.parquet(f"file://{tmp_path}/kg")
    stream = spark.readStream.schema("h string, r string, t string, ts timestamp").parquet(f"file://{tmp_path}/kg")
    assert drain(counters.first_seen(stream, "ts", "1 hour"), "append", "first").count() == 2
