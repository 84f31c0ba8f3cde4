"""Digests of ordered lines. A digest is one chain of states over its lines, so a group's lines pass one task, in order: but they
pass it batch by batch after an external sort, and nothing of them is kept but the state of the hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digests(df: DataFrame, by: str, line: Column, *order, separator: str = "\n") -> DataFrame:
    """by, n and digest: SHA-256 of each group's lines in the order, joined by the separator. Null lines count as empty."""
    rows = df.select(F.col(by).alias("by"), F.coalesce(line, F.lit("")).alias("line"), *(F.expr(o) if isinstance(o, str) else o for o in order))
    keys = rows.columns[2:]
    kind = rows.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, started = None, None, 0, False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], ["by", "n", "digest"])

        for batch in batches:
            of = batch.schema.field(0).type
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not started or group != now:
                    if started:
                        yield told()
                    now, state, n, started = group, hashlib.sha256(), 0, True
                else:
                    state.update(separator.encode())
                state.update(text.as_py().encode())
                n += 1
        if started:
            yield told()

    sorted_ = rows.repartition("by").sortWithinPartitions("by", *keys)
    return sorted_.select("by", "line").mapInArrow(run, f"by {kind}, n long, digest string").select(F.col("by").alias(by), "n", "digest")


def set_digests(df: DataFrame, by: str, line: Column) -> DataFrame:
    """by, n and digest of each group's distinct lines in their own order. Repeats go before the shuffle of lines."""
    rows = df.select(by, line.alias("line")).distinct()
    return ordered_digests(rows, by, F.col("line"), "line AS __line")


def one_digest(lines: DataFrame, line: str, end: str = "\n") -> str:
    """SHA-256 of all lines in their order, each with its end. Lines are sorted by ranges in all tasks; the driver holds one range at a time."""
    state = hashlib.sha256()
    for row in lines.select(line).orderBy(line).toLocalIterator():
        state.update((row[0] + end).encode())
    return state.hexdigest()
