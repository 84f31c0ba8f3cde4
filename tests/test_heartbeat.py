"""Runs that fall silent are heard of on time, finished ones no more."""

import time

from quillon.streaming import events


def test_silent_runs_beat_until_they_are_complete(spark, tmp_path):
    ddl = "run string, event string, processed_rows long, total_rows long"
    put = lambda rows, name: spark.createDataFrame(rows, ddl).coalesce(1).write.json(str(tmp_path / "in" / name))
    put([("a", "progress", 5, 20), ("b", "progress", 1, 4), ("b", "stage_complete", 4, 4), ("c", "progress", 0, 0)], "one")
    stream = spark.readStream.schema(ddl).json(str(tmp_path / "in" / "*"))
    query = events.heartbeats(stream, 500).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        rows = []
        until = time.time() + 120
        while time.time() < until and max((r.beats for r in rows if r.run == "a"), default=0) < 2:
            time.sleep(0.5)
            rows = spark.table("beats").collect()
        put([("a", "stage_complete", 20, 20)], "two")
        while time.time() < until and not any(r.run == "a" and r.event == "stage_complete" for r in rows):
            time.sleep(0.5)
            rows = spark.table("beats").collect()
        time.sleep(4)
        rows = spark.table("beats").collect()
    finally:
        query.stop()
    of = lambda run: [r for r in rows if r.run == run]
    a = of("a")
    beats = [r for r in a if r.event == "heartbeat"]
    assert len(beats) >= 2 and [r.beats for r in beats] == list(range(1, len(beats) + 1)) and all(r.percent_complete == 25.0 for r in beats)
    assert a[-1].event == "stage_complete" and a[-1].percent_complete == 100.0
    assert [r.event for r in of("b")] == ["progress", "stage_complete"]
    assert all(r.percent_complete is None for r in of("c")) and any(r.event == "heartbeat" for r in of("c"))
