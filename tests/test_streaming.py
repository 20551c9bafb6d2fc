from millrace.streaming.latest import first_seen, upsert_stream


def test_upsert_keeps_the_latest(spark, tmp_path):
    schema = "k long, seq long, v string, ts timestamp"
    spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", None)], schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda: upsert_stream(stream(), str(tmp_path / "out"), "k", "seq", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, "c", None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "version=1")).collect()} == {(1, "c"), (2, "b")}


def test_first_seen_drops_repeats(spark, tmp_path):
    spark.sql("select 1 k, timestamp '2024-01-01 00:00:00' ts union all select 1, timestamp '2024-01-01 00:00:05' union all select 2, timestamp '2024-01-01 00:00:01'").write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in")), ["k"], "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.sql("select k from seen").collect()) == [1, 2]
