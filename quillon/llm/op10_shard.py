"""Operator 10: sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the rows uniformly into buckets of about BUCKET_BYTES, by a seeded hash of the key and of the row's number
in its task (so equal or null keys don't share a bucket), and writes them to the shared folder; from there on a repeated
task finds every row in its bucket. Pass two brings BUCKETS buckets to a task, puts each in key order and
Fisher-Yates-shuffles it with the built-in shuffle(), whose generator follows the seed and the task. The buckets' prefix counts,
taken in two levels, make the order global. Law "rows": shard s takes places ceil(s*n/shards) up to the next shard's start, so
counts are at most one apart. For one layout of the input's files and one number of partitions the order follows the seed alone.

Null text has size 8 and checksum 0; null and repeated keys are rows like others (ties are put in order by the text). An
empty table gives an empty table. Other columns are kept; of a clashing name the operator's own column stays. A single text
is never cut: a bucket that holds one longer than BUCKET_BYTES is as large as that text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, table

SHARDS = 24
SEED = 20_240_607
BUCKET_BYTES = 4 << 20
#: Buckets that a task of pass two takes.
BUCKETS = 8
#: Levels of the prefix count: so many groups of buckets.
GROUPS = 256


def size_of(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffle_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of df in global random order, with place (from 0), shard and slot (from 0 in each shard)."""
    kept = [c for c in df.columns if c not in ("place", "shard", "slot")]
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size_of(text)), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()), F.lit(n_buckets)).alias("__bucket")
    rows = F.struct(F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    scattered = materialize(df.select(bucket, rows.alias("__row")), "scattered")

    per_group = -(-n_buckets // GROUPS)
    counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__group", F.floor(F.col("__bucket") / per_group))
    counts = materialize(counts, "counts")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("__n"))  # GROUPS rows at most
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).join(F.broadcast(groups.select("__group", first.alias("__first"))), "__group").select("__bucket", (F.col("__before") + F.col("__first")).alias("__start"))

    # a task takes its BUCKETS buckets by their numbers, not by a hash, which would give some tasks several times as many
    task = F.floor(F.col("__bucket") / BUCKETS).cast("int").alias("__task")
    held = scattered.select(task, "__bucket", "__row").repartitionById(-(-n_buckets // BUCKETS), "__task").groupBy("__task", "__bucket").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
    mixed = held.sortWithinPartitions("__bucket").select("__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
    placed = join_checked(mixed, starts, "__bucket").select("__start", F.posexplode("__rows").alias("__at", "__row"))
    placed = placed.select("__row.row", (F.col("__start") + F.col("__at")).alias("place"))
    shard = F.expr(f"cast((place * {shards}L) div {max(1, n)}L as int)")
    first = F.expr(f"(shard * {max(1, n)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select("row.*", "place", "shard", "slot")


def write_shards(df: DataFrame, path: str, files: int = 200) -> None:
    """Write shuffle_shards() as shard=N folders, each in slot order; large shards are split over files by slot range."""
    df.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
