"""Ranks and order statistics of tables and of groups, without a window over a whole table or a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def global_rank(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """df with its place from 0 in the order, which has to be total.

    Rows are range-partitioned and sorted; a place is the rank in the partition plus the rows of those before, a table of
    one row per partition. The partitioned rows are written once, as ranges are drawn from a sample."""
    placed = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("__part").count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(before), "__part").withColumn(name, rank - 1 + F.col("__before")).drop("__part", "__before")


def grouped_rank(df: DataFrame, by: list[str], *order, name: str = "pos") -> DataFrame:
    """df with its place from 0 among the rows that agree in `by`, in the order, which has to be total within a group; and n, the group's rows.

    Ranges of group and order together: a group with many rows lies in many ranges. A place is the rank within the range and
    group plus the rows of the group in the ranges before, a table of a row per range and group that meet."""
    placed = materialize(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__here"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__here").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("__part", *by, before.alias("__before"), F.sum("__here").over(w).alias("n")), "before")
    rank = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    met = placed["__part"] == counts["__part"]
    for c in by:
        met = met & placed[c].eqNullSafe(counts[c])
    placed = placed.withColumn(name, rank - 1)
    out = placed.join(counts, met, "inner").select(*(placed[c] for c in df.columns), (placed[name] + counts["__before"]).alias(name), counts["n"])
    return out


#: Ranges of one round of order_statistics.
RANGES = 1024


def order_statistics(df: DataFrame, by: str, value: str, place: Column, ranges: int = RANGES) -> DataFrame:
    """by, n and the value at a place (from 0, an expression of n) of each group's order; null values don't count.

    No group is sorted: each round counts the values of every group by equal ranges between the least and the greatest that are
    still possible, and goes on in the range that holds the place, until it holds one value. Only counts are shuffled."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"))
    state = rows.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = materialize(state.withColumn("place", place.cast("long")), "places")
    found = None
    while True:
        done = state.where("low = high or n = 0")
        found = done if found is None else found.unionAll(done)
        open_ = state.where("low < high")
        if open_.isEmpty():
            break
        # halves, as the whole width may exceed a double
        half = F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))  # null between the two least doubles, which are told apart as they are
        share = F.coalesce((F.col("v") / 2 - F.col("low") / 2) / half, (F.col("v") > F.col("low")).cast("double"))
        cut = F.least(F.lit(ranges - 1), F.floor(share * ranges)).alias("cut")
        near = rows.join(open_, "by").where("v between low and high").groupBy("by", "n", "place", cut).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("by").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = near.withColumn("before", before).where("place >= before and place < before + c")
        state = materialize(near.select("by", "n", "low", "high", (F.col("place") - F.col("before")).alias("place")), "places")
    return found.select(F.col("by").alias(by), "n", F.col("low").alias("value"))
