"""The status stream goes on after a restart, and merges no batch twice."""

from graphweave.streaming.jobs import latest_status_stream, snapshot

def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string")
    frame.selectExpr("event_id", "to_timestamp(at) as ts", "user_id", "event_type").coalesce(1).write.parquet(path)


def test_restart(spark, tmp_path):
    data, where = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    write(spark, f"{data}/a.parquet", [(1, "2024-01-01 00:00:00", 1, "view"), (2, "2024-01-02 00:00:00", 1, "view")])
    run = lambda: sorted(map(tuple, latest_status_stream(spark, data, "*.parquet", where).collect()))
    assert run() == [(1, "view", 2, 2)] and snapshot(spark, where)[0] == 0
    assert run() == [(1, "view", 2, 2)] and snapshot(spark, where)[0] == 0
    write(spark, f"{data}/b.parquet", [(3, "2024-01-01 12:00:00", 1, "view"), (4, "2024-01-01 12:00:00", 2, "view")])
    assert run() == [(1, "view", 2, 3), (2, "view", 4, 1)] and snapshot(spark, where)[0] == 1
