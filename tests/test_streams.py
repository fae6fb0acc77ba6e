"""Streams over a few files of events."""

from quern.streaming import streams


def write(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(folder)


def collect(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_repeats_windows_and_sessions(spark, tmp_path):
    folder = str(tmp_path / "events")
    write(spark, folder, [(1, "2024-01-01 00:01:00", 7, "a", 1.0, None), (1, "2024-01-01 00:01:00", 7, "a", 1.0, None), (2, "2024-01-01 00:12:00", 7, "a", 3.0, None)])
    write(spark, folder, [(3, "2024-01-01 09:00:00", 8, "b", 5.0, None), (4, "2024-01-02 09:00:00", 8, "b", 5.0, None)])
    once = collect(spark, streams.drop_repeats(streams.read_events(spark, folder), ["event_id"]), tmp_path, "once")
    assert sorted(r["event_id"] for r in once) == [1, 2, 3, 4]
    windows = collect(spark, streams.tumbling(streams.read_events(spark, folder)), tmp_path, "windows", "complete")
    assert sorted((r["event_type"], r["n"]) for r in windows) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    found = collect(spark, streams.sessions(streams.read_events(spark, folder)), tmp_path, "sessions", "complete")
    assert sorted((r["user_id"], r["n"]) for r in found) == [(7, 3), (8, 1), (8, 1)]
