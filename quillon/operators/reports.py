"""The full scoring report as one table: section, name, field, value. All levels (all rows, domains, tags) come from one aggregation
over rows that stand under each of their levels; a row counts under every one of its tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m

#: Kinds of edits: raw and normalised, words and characters.
KINDS = ("raw_words", "normalised_words", "raw_characters", "normalised_characters")
#: Rates from which a row is hard.
HARD = (("normalised_words", 100), ("normalised_words", 75), ("normalised_characters", 50))
EDITS = ("substitutions", "deletions", "insertions")


def scoring_report(rows: DataFrame, domain: str, tags: str, duration: str, empty: str) -> DataFrame:
    """rows: for each kind k a struct k of edits, k_n (length of the reference) and k_rate; and the columns named.

    Sections totals, domain and phenomenon have rows, duration, empties, hard rows, sums of edits, and corpus, mean and median rates;
    section histogram has the rows of each bucket of rates by kind and of durations. Only buckets with rows are named."""
    level = lambda section, name: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"))
    levels = F.concat(F.array(level("totals", F.lit("")), level("domain", F.coalesce(domain, F.lit("unknown")))), F.transform(tags, lambda x: level("phenomenon", x)))
    held = rows.select("*", F.explode(levels).alias("__level")).select("*", "__level.*")
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(duration).alias("duration"), F.count_if(empty).alias("empty")]
    sums += [F.count_if(F.col(f"{k}_rate") >= n).alias(f"{k}_rate_ge_{n}") for k, n in HARD]
    for k in KINDS:
        sums += [F.sum(F.col(k)[e]).alias(f"{k}_{e}") for e in EDITS]
        sums += [F.sum(sum((F.col(k)[e] for e in EDITS), F.lit(0))).alias(f"{k}_distance"), F.sum(f"{k}_n").alias(f"__{k}_n"), F.avg(f"{k}_rate").alias(f"{k}_mean"), F.median(f"{k}_rate").alias(f"{k}_median")]
    found = held.groupBy("section", "name").agg(*sums)
    found = found.withColumns({f"{k}_corpus": m.percent(F.col(f"{k}_distance"), F.col(f"__{k}_n")) for k in KINDS})
    fields = [c for c in found.columns if c not in ("section", "name") and not c.startswith("__")]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in fields)))
    table = found.select("section", "name", cells.alias("c")).select("section", "name", "c.*")
    buckets = F.array(*(F.struct(F.lit(k).alias("name"), m.error_bucket(F.col(f"{k}_rate")).alias("field")) for k in KINDS), F.struct(F.lit("duration").alias("name"), m.duration_bucket(F.col(duration)).alias("field")))
    counts = rows.select(F.explode(buckets).alias("b")).groupBy("b.name", "b.field").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return table.unionByName(counts.withColumn("section", F.lit("histogram")))
