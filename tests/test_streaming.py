from causeway.streaming import incremental


def test_rescanned_sources_count_once(spark, tmp_path):
    into, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    schema = "src string, dst string, kind string, weight long, line int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(into)
        incremental.keep_latest(spark, spark.readStream.schema(schema).parquet(into), out, at).awaitTermination()

    arrive([("a", "b", "value", 1, 1), ("a", "b", "value", 1, 2), ("c", "b", "type", 1, 1)])
    arrive([("a", "d", "value", 1, 5)])
    got = sorted(tuple(r)[:4] for r in incremental.current_edges(spark, out).collect())
    assert got == [("a", "d", "value", 1), ("c", "b", "type", 1)]
    assert {tuple(r) for r in incremental.replaced(spark, out).collect()} == {("a", 2), ("c", 1)}
