"""Guards and proofs over several tables: reviews, one-to-one manifests, coverage of schedules, overlaps of partitions, projections by an allow-list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import refuse
from .contracts import all_broken, blank
from .ranks import global_rank


def review_issues(reviews: DataFrame, key: str, outcome: str, allowed: tuple[str, ...], order: str) -> DataFrame:
    """Reviews with issues: duplicate_id (an earlier one has the id; null ids are ids of nothing) and bad_outcome (none of the allowed, or null)."""
    earlier = F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
    bad = ~F.coalesce(F.col(outcome).isin(*allowed), F.lit(False))
    return reviews.withColumn("__again", earlier).withColumn("issues", all_broken(("duplicate_id", F.col("__again") & F.col(key).isNotNull()), ("bad_outcome", bad))).drop("__again")


def sound_reviews(reviews: DataFrame, key: str, outcome: str, allowed: tuple[str, ...], order: str) -> DataFrame:
    """The reviews as they are; the first one with an issue is refused."""
    refuse(review_issues(reviews, key, outcome, allowed, order).where(F.size("issues") > 0), "broken review")
    return reviews


def one_to_one_issues(left: DataFrame, right: DataFrame, key: str, fields: tuple[str, ...] = (), unique: tuple[str, ...] = ()) -> DataFrame:
    """key and issues of a full join: missing_left, missing_right, <field>_differs (nulls are equal to nulls), <column>_repeated.

    `unique` are columns of the right side that may hold a value once; the key may occur once on each side. A key that is null
    on a side matches nothing there."""
    many = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(c)
    said = right
    for c in unique:
        said = said.join(many(right, c).withColumn(f"__many_{c}", F.lit(True)), c, "left")
    l = left.select(F.col(key).alias("__k"), F.struct(*fields, F.lit(1).alias("__there")).alias("l"))
    r = said.select(F.col(key).alias("__k"), F.struct(*fields, *(f"__many_{c}" for c in unique), F.lit(1).alias("__there")).alias("r"))
    n = Window.partitionBy("__k")
    both = l.join(r, "__k", "full").withColumn("__n", F.count(F.lit(1)).over(n))
    here = F.col("l").isNotNull() & F.col("r").isNotNull()
    rules = [("missing_left", F.col("l").isNull()), ("missing_right", F.col("r").isNull())]
    rules += [(f"{f}_differs", here & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))) for f in fields]
    rules += [(f"{c}_repeated", F.coalesce(F.col(f"r.__many_{c}"), F.lit(False))) for c in unique]
    rules += [(f"{key}_repeated", (F.col("__n") > 1) & F.col("__k").isNotNull())]
    return both.select(F.col("__k").alias(key), all_broken(*rules).alias("issues"))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], both_ways: bool = False) -> DataFrame:
    """The inner join; rows of the left side without a partner are refused, with both_ways those of the right side too."""
    refuse(left.join(right, keys, "left_anti").select(*keys), "no partner on the right")
    if both_ways:
        refuse(right.join(left, keys, "left_anti").select(*keys), "no partner on the left")
    return left.join(right, keys)


def coverage(slice_: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """One row: scheduled (rows), covered (distinct keys scheduled that are records), unscheduled, unknown (distinct keys that are no records) and repeated (distinct keys scheduled more than once)."""
    seen = slice_.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = seen.join(records.select(key).distinct().withColumn("__r", F.lit(True)), key, "full")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    known, scheduled = F.col("__r").isNotNull(), F.col("__n").isNotNull()
    return both.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("scheduled"), n(known & scheduled).alias("covered"), n(known & ~scheduled).alias("unscheduled"), n(~known).alias("unknown"), n(F.col("__n") > 1).alias("repeated"))


def overlap_proof(a: DataFrame, b: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """key_name, left and right (distinct values) and shared, for each named key; null and blank values count for nothing.

    All keys travel as (name, value) through one shuffle; a value's rows are folded to one before it."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key_name"), c.cast("string").alias("value")) for k, c in keys.items()))
    side = lambda df, name: df.select(F.inline(pairs)).where(F.coalesce(F.trim("value"), F.lit("")) != "").withColumn("side", F.lit(name))
    values = side(a, 1).unionAll(side(b, 2)).groupBy("key_name", "value").agg(F.bit_or("side").alias("sides"))
    n = lambda *s: F.count(F.when(F.col("sides").isin(*s), F.lit(1)))
    found = values.groupBy("key_name").agg(n(1, 3).alias("left"), n(2, 3).alias("right"), n(3).alias("shared"))
    names = a.sparkSession.createDataFrame([(k,) for k in keys], "key_name string")
    return names.join(F.broadcast(found), "key_name", "left").fillna(0, ["left", "right", "shared"])  # a row per named key


def first_rows(df: DataFrame, order: str, count: int) -> DataFrame:
    return df.orderBy(order).limit(count)


def marked(rounds: DataFrame, by: str, chosen: DataFrame) -> DataFrame:
    """Rounds with `selected`; chosen: `by` and round. A group without a choice has no selected round."""
    picked = chosen.select(by, F.col("round").alias("__round"))
    return rounds.join(picked, by, "left").withColumn("selected", F.coalesce(F.col("round") == F.col("__round"), F.lit(False))).drop("__round")


def guidance(items: DataFrame, text: str, marks: str) -> DataFrame:
    """Trimmed items without blank ones, and `refused`: whether the item holds a mark (a pattern)."""
    return items.withColumn(text, F.trim(text)).where(~blank(F.col(text))).withColumn("refused", F.col(text).rlike(marks))


def allowed_only(df: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """The column's struct with the fields of the list alone, nested as they are; a path that isn't there is left out, a null struct stays null."""
    wanted = {tuple(p.split(".")) for p in paths}

    def part(c: Column, kind: T.StructType, at: tuple[str, ...]) -> Column | None:
        fields = []
        for f in kind.fields:
            here = (*at, f.name)
            if here in wanted:
                fields.append(c.getField(f.name).alias(f.name))
            elif isinstance(f.dataType, T.StructType) and (inner := part(c.getField(f.name), f.dataType, here)) is not None:
                fields.append(inner.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else None

    kept = part(F.col(column), df.schema[column].dataType, ())
    return df.drop(column) if kept is None else df.withColumn(column, kept)


def nested(json: str, paths: dict[str, tuple[str, str, object]]) -> list[Column]:
    """Columns from JSON text: name -> (path, type, default); the default stands for what is missing, null or of another type."""
    return [F.coalesce(F.get_json_object(json, path).try_cast(kind), F.lit(default).cast(kind)).alias(name) for name, (path, kind, default) in paths.items()]


def merged_texts(workers: list[DataFrame], inherited: DataFrame, key: str, cell: str, form: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: the inherited rows followed by the workers' new ones, of each cell the `keep` first by key, with `position`; and the
    cells that are still short with their deficit.

    A new row whose form an inherited row or a row with a smaller key has is left out; null forms are copies of nothing."""
    new = reduce(DataFrame.unionByName, workers).select(key, cell, form)
    old = inherited.select(key, cell, form)
    known = old.select(form).where(F.col(form).isNotNull()).distinct()
    least = new.where(F.col(form).isNotNull()).groupBy(form).agg(F.min(key).alias("__least"))
    fresh = new.join(known, form, "left_anti").join(least, form, "left").where(F.col("__least").isNull() | (F.col(key) == F.col("__least"))).select(key, cell)
    placed = global_rank(fresh, cell, key, name="__pos")
    starts = placed.groupBy(cell).agg(F.min("__pos").alias("__start"), F.count(F.lit(1)).alias("__have"))
    chosen = placed.join(starts, cell).where(F.col("__pos") - F.col("__start") < keep).select(key, cell)
    both = old.select(key, cell, F.lit(0).alias("part")).unionAll(chosen.withColumn("part", F.lit(1)))
    cells = old.select(cell).unionAll(new.select(cell)).distinct()
    deficit = F.greatest(keep - F.coalesce("__have", F.lit(0)), F.lit(0))
    short = cells.join(starts, cell, "left").select(cell, deficit.alias("deficit")).where("deficit > 0")
    return global_rank(both, "part", key, name="position"), short
