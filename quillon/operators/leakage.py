"""Leakage between partitions and collisions within them, over any number of keys or views at once.

Keys are unpivoted into one table (partition, key, value), so that all of them go through one shuffle. Empty values say nothing.
A value that many rows share is one row of an index; only its first two rows are looked up, by a limit that every task applies
before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def _long(rows: DataFrame, keys: list[str], *keep: str) -> DataFrame:
    """keep, key, value: a row for each key of each row that has one."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)))
    return rows.select(*keep, cells.alias("c")).select(*keep, "c.key", "c.value").where("value <> ''")


def cross_partition(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]], role: str = "partition_role", key: str = "candidate_id") -> DataFrame:
    """code, partition_role (left/right), candidate_id, related_id: rows of a left partition with a key that the right one has too; the related row is the last of that key."""
    held = materialize(_long(rows, keys, role, key), "keys")
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs)))  # as many as are given
    lefts = held.join(F.broadcast(held.sparkSession.range(1).select(sides.alias("s")).select("s.*")), F.col(role) == F.col("left"))
    last = held.where(F.col(role).isin([b for _, b in pairs])).groupBy(F.col(role).alias("right"), "key", "value").agg(F.max(key).alias("related_id"))
    found = lefts.join(materialize(last, "last"), ["right", "key", "value"])
    return found.select(F.concat(F.lit("cross_partition_"), "key", F.lit("_overlap")).alias("code"), F.concat_ws("/", "left", "right").alias("partition_role"), F.col(key).alias("candidate_id"), "related_id")


def absent_sources(rows: DataFrame, of: str, among: str, source: str, role: str = "partition_role") -> DataFrame:
    """The rows of one partition whose source another hasn't; none if that one is empty."""
    known = materialize(rows.where(F.col(role) == among).select(source).distinct(), "known")
    if known.isEmpty():
        return rows.limit(0)
    met = rows[source].eqNullSafe(known[source])
    return rows.where(F.col(role) == of).join(known, met, "left_anti")


def collisions(rows: DataFrame, views: dict[str, bool], family: Column, approved: Column, most: int, role: str = "partition_role", key: str = "candidate_id") -> DataFrame:
    """code, partition_role, candidate_id, related_id, n: groups of rows of one partition that agree in a view; the first two rows stand for them.

    views: whether a view may be shared by an approved group: of one family, at most `most` rows, every row in a family and approved."""
    rows = rows.withColumns({"__family": family, "__approved": F.coalesce(approved, F.lit(False)) & family.isNotNull()})
    held = materialize(_long(rows, list(views), role, key, "__family", "__approved"), "views")
    exempt = F.every("__approved") & (F.min("__family") == F.max("__family")) & (F.count(F.lit(1)) <= most)
    groups = held.groupBy(role, "key", "value").agg(F.count(F.lit(1)).alias("n"), exempt.alias("exempt")).where("n > 1")
    allowed = F.col("key").isin([v for v, ok in views.items() if ok])
    groups = materialize(groups.where(~(allowed & F.coalesce("exempt", F.lit(False)))).drop("exempt"), "groups")
    place = F.row_number().over(Window.partitionBy(role, "key", "value").orderBy(key))
    two = held.select(role, "key", "value", key, place.alias("place")).where("place <= 2").groupBy(role, "key", "value")
    two = two.agg(F.min(key).alias("candidate_id"), F.max(key).alias("related_id"))
    out = groups.join(two, [role, "key", "value"])
    return out.select(F.concat(F.lit("within_partition_"), "key", F.lit("_collision")).alias("code"), F.col(role).alias("partition_role"), "candidate_id", "related_id", "n")


def distinct_counts(rows: DataFrame, views: list[str], role: str = "partition_role", key: str = "candidate_id") -> DataFrame:
    """partition_role (null over all), view, rows and distinct values of each view."""
    held = _long(rows, views, role, key)
    seen = held.groupBy(role, "key", "value").agg(F.count(F.lit(1)).alias("rows"))
    by = seen.groupBy(role, "key").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    over = seen.groupBy("key", "value").agg(F.sum("rows").alias("rows")).groupBy("key").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_values"))
    return by.unionByName(over.withColumn(role, F.lit(None).cast("string"))).select(role, F.col("key").alias("view"), "rows", "distinct_values")
