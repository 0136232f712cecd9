from tidewheel.streaming import views


def test_streaming_view_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 5, 1), ("2024-01-01 00:04:00", 7, 0), ("2024-01-01 00:31:00", 1, 1)]
    df = spark.createDataFrame(rows, "ts string, total_tokens long, response_tokens long").selectExpr("cast(ts as timestamp) ts", "total_tokens", "response_tokens")
    df.write.parquet(f"{tmp_path}/in")
    stream = views.streaming_time_view(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("views").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("views").collect()
    assert [(r.request_count, r.total_tokens, r.zero_response_count) for r in got] == [(2, 12, 1)]


def test_streaming_alarms_keep_their_gap(spark, tmp_path):
    spark.createDataFrame([(1, p) for p in (0, 5, 288, 290, 600)], "series int, position long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = views.streaming_alarms(spark.readStream.schema("series int, position long").parquet(f"{tmp_path}/in"), 288)
    q = stream.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.position for r in spark.table("alarms").collect()) == [0, 288, 600]
