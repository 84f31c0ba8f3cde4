"""Ranks, order statistics and digests of groups that may hold most of a table. The statements are those of the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.digests import ordered_digests, set_digests
from ..operators.ranks import grouped_rank, order_statistics
from ..sources.tables import table
from .relational import DUCK, STATEMENTS


def dist_floor_rank(spark, sf_dir):
    """sorted[min(n - 1, floor(0.95 n))] of each event type."""
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return order_statistics(table(spark, sf_dir, "events"), "event_type", "value", place).select("event_type", F.col("value").alias("p95"), "n")


def dist_bankers_rank(spark, sf_dir):
    """sorted[round((n - 1) * 0.95)], halves to even."""
    return order_statistics(table(spark, sf_dir, "events"), "event_type", "value", F.bround((F.col("n") - 1) * 0.95, 0)).select("event_type", F.col("value").alias("p95"), "n")


def shard_assignment(spark, sf_dir):
    """Items of each voice in the order of their hashes, dealt to four workers in turn."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("voice")).distinct()
    placed = grouped_rank(items.withColumn("h", F.sha2(F.col("item").cast("string"), 256)), ["voice"], "h", "item")
    return placed.select("item", "voice", (F.col("pos") % 4).alias("worker"))


def topk_per_cell(spark, sf_dir):
    """The first 25 of each language by hash, of which 20 are selected. Only 25 rows of each task and language are shuffled."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return d.withColumn("place", place).where("place <= 25").select("doc_id", "lang", (F.col("place") <= 20).alias("selected"))


def split_by_hash_rank(spark, sf_dir):
    """Of each language the first 95 of 100 by hash are for training."""
    d = table(spark, sf_dir, "documents")
    h = F.sha2(F.concat(F.lit("corpus"), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256)
    placed = grouped_rank(d.select("lang", "doc_id", h.alias("h")), ["lang"], "h", "doc_id")
    return placed.select("lang", "doc_id", (F.col("pos") + 1 <= F.floor(F.col("n") * 0.95)).alias("training"))


def directional_suite(spark, sf_dir):
    """Items and holdout documents one after another, with ids made anew for each split."""
    a = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("split"), F.col("item_id").alias("id"))
    b = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.lit("holdout").alias("split"), F.col("doc_id").alias("id"))
    placed = grouped_rank(a.unionAll(b), ["split"], "id", name="i")
    first = F.broadcast(a.agg(F.count(F.lit(1)).alias("first")))  # one row
    sample = F.concat_ws(":", "split", F.lpad(F.col("i").cast("string"), 4, "0"))
    placed = placed.join(first, F.lit(True))
    return placed.select(sample.alias("sample_id"), "split", "id", (F.col("i") + F.when(F.col("split") == "holdout", F.col("first")).otherwise(0)).alias("position"))


def set_digest(spark, sf_dir):
    return set_digests(table(spark, sf_dir, "part"), "p_brand", F.concat_ws("|", "p_brand", "p_type"))


def ordered_digest(spark, sf_dir):
    return ordered_digests(table(spark, sf_dir, "conversations"), "conv_id", F.col("role"), "turn", separator=":")


_ALL = (dist_floor_rank, dist_bankers_rank, shard_assignment, topk_per_cell, split_by_hash_rank, directional_suite, set_digest, ordered_digest)
QUERIES = {f.__name__: (f, STATEMENTS[f.__name__](DUCK)) for f in _ALL}
