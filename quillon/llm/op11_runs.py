"""Operator 11: periodic run detection by Kolpakov and Kucherov (kernels in runs.py).

Each document is one unit of work, whole, in the task that holds it: its words become codes, an LZ factorisation comes from
the automaton of its suffixes, Main's search finds the runs that meet a factor's boundary, and runs within a factor are copied
from its earlier occurrence. Runs of an exponent above 2 lie where stretches of words occur again near themselves; places
outside repeated stretches are cut away first, which is exact (see runs.width), so plain prose costs little.

A word is [^\\x20\\x09-\\x0D]+. Null and empty texts have no words, no runs and an empty collapsed text. Long texts need time
and memory in proportion to their longest repeated stretch. Rows keep their number: null and repeated keys and repeated rows
are judged row by row. Runs that tie in length are all given, by start and period. An empty table gives an empty table. Other
columns are kept; of a clashing name the operator's own column stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, carried, small_batches, table, with_row
from .runs import runs, stretches, width

SHORTEST, EXPONENT = 6, 4.0
OWN = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def runs_of(data: bytes, shortest: int, exponent: float) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, the runs as (start, length, period), and the words without those that a run holds after its first period."""
    words = data.split()
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=len(words))

    def least(q: int) -> int:
        return max(shortest, int(np.ceil(exponent * q)))

    found = []
    drop = np.zeros(len(words), dtype=bool)
    for start, end in stretches(codes, width(shortest, exponent)):
        if end - start >= shortest:
            for b, f, q in runs(codes[start:end].tolist(), least, exponent):
                found.append((start + b, f - b, q))
                drop[start + b + q : start + f] = True
    return len(words), found, b" ".join([w for w, gone in zip(words, drop.tolist(), strict=True) if not gone] if found else words)


def periodic_runs(df: DataFrame, text: str = "text", shortest: int = SHORTEST, exponent: float = EXPONENT) -> DataFrame:
    """The rows of df with n_words, runs (start, length and period in words, by start and period) and collapsed, for runs of at
    least max(shortest, exponent * period) words. shortest must be 1 at least, exponent 2 at least."""
    if shortest < 1 or exponent < 2:
        raise ValueError("runs have an exponent of 2 at least and a positive length")
    small_batches(df.sparkSession)
    source = df.select(carried(df, ["n_words", "runs", "collapsed"]), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    schema = with_row(source, OWN)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, kept = [], [], []
            for cell in batch.column(1):
                words, those, rest = runs_of(cell.as_py(), shortest, exponent)
                n.append(words)
                found.append([{"start": b, "length": size, "period": q} for b, size, q in those])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["__row", "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, schema).select("__row.*", "n_words", "runs", "collapsed")


def with_period(key: str, text: str):
    """The text, in which for a tenth of the keys, told by their checksum, a stretch up to the end repeats with one period."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a)), " ")).otherwise(F.lit(""))

    once = F.array(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))  # bound once in the lambda
    return F.when(h % 10 == 0, F.transform(once, changed)[0]).otherwise(F.col(text))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period("doc_id", "text").alias("text"))
    found = periodic_runs(docs).drop("text")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
