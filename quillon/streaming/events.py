"""Event streams: windows with a watermark, progress measures, and a patience rule with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def progress(events: DataFrame) -> DataFrame:
    """Percent and seconds left, from steps if they are counted, else from rows."""
    done = F.coalesce(F.try_divide("step", "total_steps"), F.try_divide("processed_rows", "total_rows"))
    return events.withColumn("percent_complete", F.round(done * 100, 3)).withColumn("eta_seconds", F.round(F.try_divide(F.col("elapsed_seconds") * (1 - done), done), 3))


def _patience(limit: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, best_round, last = state.get if state.exists else (float("inf"), 0, 0)
        for batch in batches:
            for r, wer in batch.sort_values("round")[["round", "wer"]].itertuples(index=False):
                if wer < best:
                    best, best_round = float(wer), int(r)
                last = max(last, int(r))
        state.update((best, best_round, last))
        yield pd.DataFrame({"run": [key[0]], "best_round": [best_round], "last_round": [last], "stop": [last - best_round >= limit]})

    return run


def patience(curve: DataFrame, limit: int = 3) -> DataFrame:
    """run, best_round, last_round, stop: whether `limit` rounds have gone by since the last strictly better one. Rounds of a run come in order."""
    return curve.groupBy("run").applyInPandasWithState(_patience(limit), "run string, best_round long, last_round long, stop boolean", "best double, best_round long, last_round long", "update", "NoTimeout")


HEARTBEAT = "run string, event string, beats long, processed_rows long, total_rows long, percent_complete double"


def _heartbeats(interval: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, total, beats, closed = state.get if state.exists else (0, 0, 0, False)
        rows = []
        if state.hasTimedOut:
            beats += 1
            rows.append("heartbeat")
        for batch in batches:
            for step in batch.sort_values("processed_rows").itertuples(index=False):
                done, total = max(done, int(step.processed_rows)), max(total, int(step.total_rows))
                closed = closed or step.event in ("stage_complete", "stage_failed")
                rows.append(step.event)
        state.update((done, total, beats, closed))
        if not closed:
            state.setTimeoutDuration(interval)
        share = round(done / total * 100, 6) if total else None
        yield pd.DataFrame({"run": key[0], "event": rows, "beats": beats, "processed_rows": done, "total_rows": total, "percent_complete": share})

    return run


def heartbeats(steps: DataFrame, interval: str | int = 30_000) -> DataFrame:
    """The events of each run (run, event, processed_rows, total_rows) as they come, and a heartbeat whenever a run has been silent for
    `interval` milliseconds of processing time, until its stage is complete or has failed. A heartbeat repeats the last progress.

    The timer is state like the progress, so a restarted query goes on beating."""
    return steps.groupBy("run").applyInPandasWithState(_heartbeats(int(interval)), HEARTBEAT, "done long, total long, beats long, closed boolean", "append", "ProcessingTimeTimeout")
