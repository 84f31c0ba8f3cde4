"""Driver tables as the record sets of the analytics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("synthetic_candidate", "selected_training", "synthetic_holdout")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(doc_id):
    """One tenth of the documents is holdout, two tenths are training."""
    m = F.pmod(doc_id, F.lit(10))
    return F.when(m == 0, ROLES[2]).when(m <= 2, ROLES[1]).otherwise(ROLES[0])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, target_text, partition_role, source_family_id, domain, duration_seconds"""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("target_text"), role(F.col("doc_id")).alias("partition_role"), F.col("source").alias("source_family_id"), F.col("lang").alias("domain"), (F.col("n_chars") / 15.0).alias("duration_seconds"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference/hypothesis pairs: a turn of a conversation and the turn before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("text").over(w).alias("reference"), F.col("text").alias("hypothesis"))
    return c.where(F.col("reference").isNotNull())


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and keeps what is drawn at random as it is."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
