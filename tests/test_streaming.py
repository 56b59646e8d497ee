from veilframe.streaming import mask


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(i, f"付款 {20000 + i} 元" if i % 2 else "nothing", f"c{i % 40}", "p") for i in range(100)]
    spark.createDataFrame(rows, "id long, text string, name string, prefix string").selectExpr("*", "timestamp_seconds(id) AS t").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, df, want in (("found", mask.scan_stream(stream, "text"), 50), ("names", mask.alias_stream(stream, "name", "prefix", "t"), 40)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
    assert {r.redacted for r in spark.table("found").collect()} == {"0.02百万元"}
    assert len({r.alias for r in spark.table("names").collect()}) == 40
    assert mask.type_counts(stream, "text", "t").isStreaming
