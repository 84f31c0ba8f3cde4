"""Operators put together from others: numbered issues, approvals of groups, ledgers, merged manifests, plans and their leftovers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import all_broken
from .ranks import global_rank


def numbered_issues(df: DataFrame, blank: Column, reason: Column, *order: Column | str) -> DataFrame:
    """The rows with a reason, with their ordinal from 1 among the rows that aren't blank."""
    named = df.withColumns({"__blank": F.coalesce(blank, F.lit(False)), "reason": reason}).where("not __blank").drop("__blank")
    return global_rank(named, *order, name="ordinal").withColumn("ordinal", F.col("ordinal") + 1).where("reason is not null")


def approved_groups(df: DataFrame, group: str, family: Column, role: Column, approved: Column, most: int = 8) -> DataFrame:
    """group, rows, approved: every row of the group is in a family and approved, all are of one family and role, and they are at most `most`."""
    seen = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.every(family.isNotNull() & F.coalesce(approved, F.lit(False))).alias("all"), (F.min(family) == F.max(family)).alias("one"), (F.min(role) == F.max(role)).alias("same"))
    return seen.select(group, "rows", F.coalesce(F.col("all") & F.col("one") & F.col("same") & (F.col("rows") <= most), F.lit(False)).alias("approved"))


def whole_file(rows: DataFrame, key: str, outcome: str, expected_rows: int | None = None, expected_digest: str | None = None) -> DataFrame:
    """One decision for every row: `outcome` if the rows are as many as expected and add up to the digest, else BLOCKED.

    The digest is the sum, as a number modulo 2^61 - 1, of the first 15 hex digits of each row's SHA-256, so that no order and no
    list of all rows is needed."""
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.agg(F.count(F.lit(1)).alias("rows"), (F.coalesce(F.sum(part), F.lit(0)) % F.lit(2**61 - 1)).cast("string").alias("digest"))
    fits = F.lit(True)
    if expected_rows is not None:
        fits = fits & (F.col("rows") == expected_rows)
    if expected_digest is not None:
        fits = fits & (F.col("digest") == expected_digest)
    return rows.crossJoin(F.broadcast(one)).withColumn("outcome", F.when(fits, outcome).otherwise("BLOCKED"))  # one row


def split_matches(records: DataFrame, predictions: DataFrame, key: str, split: str) -> DataFrame:
    """split, matched, missing, unexpected (under a null split), and exact: whether both sets of keys are equal over all splits."""
    both = records.select(key, split, F.lit(True).alias("__r")).join(predictions.select(key, F.lit(True).alias("__p")), key, "full")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    counts = both.groupBy(split).agg(n(F.col("__r") & F.col("__p")).alias("matched"), n(F.col("__p").isNull()).alias("missing"), n(F.col("__r").isNull()).alias("unexpected"))
    total = counts.agg((F.sum(F.col("missing") + F.col("unexpected")) == 0).alias("exact"))
    return counts.crossJoin(F.broadcast(total))  # one row


def ledger(df: DataFrame, key: str, form: Column, reason: Column, cell: str, keep: int, seed: str) -> DataFrame:
    """key and decision. In this order: `duplicate` (a smaller key has the form), the given reason, then of each cell the `keep` rows
    that come first by the seeded hash are `selected` and the others `overflow`; a cell with too few has `short` beside it.

    Places in a cell come from a global rank by cell, so a cell of any size is ranked by many tasks."""
    first = df.select(key, cell, F.sha2(form, 256).alias("__h"), reason.alias("__reason"))
    least = first.groupBy("__h").agg(F.min(key).alias("__least"))
    judged = first.join(least, "__h", "left").withColumn("decision", F.when(F.col(key) != F.col("__least"), "duplicate").otherwise(F.col("__reason"))).select(key, cell, "decision")
    placed = global_rank(judged.where("decision is null").select(key, cell), cell, F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    starts = placed.groupBy(cell).agg(F.min("pos").alias("__start"), F.count(F.lit(1)).alias("__n"))
    chosen = placed.join(starts, cell)
    decision = F.when(F.col("pos") - F.col("__start") < keep, "selected").otherwise("overflow")
    chosen = chosen.select(key, cell, decision.alias("decision"), (F.col("__n") < keep).alias("short"))
    return judged.where("decision is not null").select(key, cell, "decision", F.lit(False).alias("short")).unionAll(chosen)


def complete_shards(workers: list[DataFrame], shard: str, done: Column) -> DataFrame:
    """The rows of all workers in shards of which every row is done."""
    rows = reduce(DataFrame.unionAll, (w.withColumn("worker", F.lit(i)) for i, w in enumerate(workers)))
    whole = rows.groupBy("worker", shard).agg(F.every(F.coalesce(done, F.lit(False))).alias("__whole")).where("__whole").drop("__whole")
    return rows.join(whole, ["worker", shard])


def merged_manifests(workers: list[DataFrame], key: list[str], seconds: str, by: str) -> DataFrame:
    """by, rows, seconds and repeated (keys that occur more than once) over the union of the workers' manifests."""
    rows = reduce(DataFrame.unionByName, workers)
    per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.sum(seconds).alias("__s"))
    return per_key.groupBy(by).agg(F.sum("__n").alias("rows"), F.round(F.sum("__s"), 4).alias("seconds"), F.count(F.when(F.col("__n") > 1, 1)).alias("repeated"))


def rotating_choice(rows: DataFrame, key: str, dimension: str, values: list[str]) -> DataFrame:
    """Of each key's rows those with the value whose turn it is: keys in order take the values in turn."""
    placed = global_rank(rows.select(key).distinct(), key)
    turn = placed.withColumn(dimension, F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("pos") % len(values) + 1).cast("int")))
    return turn.join(rows, [key, dimension])


def plan(items: DataFrame, styles: DataFrame, most_styles: int = 10_000) -> DataFrame:
    """Every item in every style; the styles are few, and counted before they are sent to all executors."""
    if (n := styles.limit(most_styles + 1).count()) > most_styles:
        raise ValueError(f"more than {n - 1} styles")
    return items.crossJoin(F.broadcast(styles))


def done_and_left(planned: DataFrame, artefacts: DataFrame, key: list[str]) -> DataFrame:
    """The plan with `done`: whether an artefact is there."""
    there = artefacts.select(*key).distinct().withColumn("__there", F.lit(True))
    return planned.join(there, key, "left").withColumn("done", F.coalesce("__there", F.lit(False))).drop("__there")


def overridden(outcomes: DataFrame, failures: DataFrame, key: list[str], order: str) -> DataFrame:
    """Outcomes (column outcome), replaced by the latest observed failure where there is one."""
    last = failures.groupBy(*key).agg(F.max_by("outcome", order).alias("__last"))
    return outcomes.join(last, key, "left").withColumn("outcome", F.coalesce("__last", "outcome")).drop("__last")


def first_passed(outcomes: DataFrame, key: str, size: str) -> DataFrame:
    """key and the largest size that passed; null if none did."""
    return outcomes.groupBy(key).agg(F.max(F.when(F.col("outcome") == "PASSED", F.col(size))).alias("chosen"))


def index_issues() -> Column:
    """What is wrong with a protected index's header: schema, version, normaliser, hashes that aren't sorted and distinct, a count that differs."""
    c = F.col
    return all_broken(
        ("schema", F.coalesce(c("schema") != "protected-index", F.lit(True))),
        ("version", F.coalesce(c("version") != "1.0", F.lit(True))),
        ("normaliser", F.coalesce(c("normaliser") != "nfc-surface", F.lit(True))),
        ("order", F.coalesce(c("hashes") != F.array_sort(F.array_distinct("hashes")), F.lit(True))),
        ("count", F.coalesce(c("count") != F.size("hashes"), F.lit(True))),
    )


def gate_issues(manifest: DataFrame, index: str, digest: str, expected: DataFrame) -> DataFrame:
    """Gates whose manifest and metadata differ. expected: gate, rows, digests (an array); manifest: gate, index, digest.

    gate and issues: rows, index_coverage (not exactly 0 to rows - 1), digests (another set)."""
    seen = manifest.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    named = expected.select("gate", "rows", F.explode(F.array_distinct("digests")).alias("__d")).select("gate", "__d")
    here = manifest.select("gate", F.col(digest).alias("__d")).distinct().withColumn("__here", F.lit(1))
    off = named.withColumn("__said", F.lit(1)).join(here, ["gate", "__d"], "full").groupBy("gate").agg(F.count(F.when(F.col("__here").isNull() | F.col("__said").isNull(), 1)).alias("off"))
    both = expected.select("gate", "rows").join(seen, "gate", "full").join(off, "gate", "left")
    wrong = lambda c: F.coalesce(c, F.lit(True))
    return both.select("gate", all_broken(("rows", wrong(F.col("n") != F.col("rows"))), ("index_coverage", wrong((F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))), ("digests", F.coalesce(F.col("off"), F.lit(0)) > 0)).alias("issues"))


def selection_ids(chosen: DataFrame, reason: str, first: str, *order: Column | str) -> DataFrame:
    """Rows with rank (from 1 over all, those of the reason `first` before the others) and id, the reason with its own rank in three digits."""
    ranked = chosen.withColumn("rank", F.row_number().over(Window.orderBy(F.col(reason) != first, *order)))  # a selection is small by its definition
    own = F.row_number().over(Window.partitionBy(reason).orderBy("rank"))
    return ranked.withColumn("selection_id", F.concat_ws("-", F.col(reason), F.lpad(own.cast("string"), 3, "0")))
