"""What the training-data operators share: tables, shared-folder materialisation, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: the longest runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes per Arrow batch; documents may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: A table of at most this many rows of a few dozen bytes may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, as whole texts travel in them. The settings stay in the session: plans are lazy and read them when they run."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) != str(most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def release() -> None:
    """Give back what earlier tasks of this worker have freed: Python workers live on, and each stage's peak would stay with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again. A lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def texts_in_row(batch: pa.RecordBatch, name: str) -> list[str]:
    """Strings of a column that travels in __row; null counts as empty."""
    return [x or "" for x in pc.struct_field(batch.column("__row"), name).to_pylist()]


def lower_ascii(column):
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def carried(df: DataFrame, own: list[str]):
    """The columns of df as one struct column __row, without those that the operator makes itself; so no name can clash within the operator."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in own)).alias("__row")


def with_row(df: DataFrame, ddl: str) -> T.StructType:
    """The type of an operator's output: __row as in df, then ddl."""
    return T.StructType([df.schema["__row"], *T.StructType.fromDDL(ddl).fields])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: files of ids and codes are small for their rows, and what is exploded from them is taken
    to be as small, so that a side of many rows would pass the driver."""
    return df.hint("merge")


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join with a broadcast only if the right side's size has been checked; else a shuffle join that AQE may split."""
    return left.join(F.broadcast(right) if bounded(right) else right, on, how)
