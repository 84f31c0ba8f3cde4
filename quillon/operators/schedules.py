"""Deterministic layouts: batches, epoch permutations, exposure rounds, rotating profiles and their parameters."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import chosen, unit_interval
from .ranks import global_rank

#: Batches of an epoch whose order is drawn on the driver.
MOST_BATCHES = 5_000_000


def batches(df: DataFrame, size: int, *order) -> DataFrame:
    """df with pos and batch: chunks of `size` in a total order."""
    return global_rank(df, *order).withColumn("batch", F.floor(F.col("pos") / size))


def padding(laid: DataFrame, duration: str, size: int) -> DataFrame:
    """batches, padded and actual seconds, ratio, and the rows of the last batch if it is short."""
    by = laid.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max(duration).alias("longest"), F.sum(duration).alias("total"))
    out = by.agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("longest") * F.col("n")).alias("padded"), F.sum("total").alias("actual"), F.coalesce(F.min(F.when(F.col("n") < size, F.col("n"))), F.lit(0)).alias("final_partial"))
    return out.withColumn("ratio", F.coalesce(F.round(F.try_divide("padded", "actual"), 6), F.lit(0.0)))


def epoch_order(spark: SparkSession, n: int, seed: int, epoch: int) -> DataFrame:
    """batch and place: the seeded permutation of an epoch's batches. The generator is sequential, so it runs on the driver, over numbers only."""
    if n > MOST_BATCHES:
        raise ValueError(f"{n} batches are too many for one permutation")
    order = list(range(n))
    random.Random(seed + epoch).shuffle(order)
    return spark.createDataFrame([(b, i) for i, b in enumerate(order)], "batch long, place long")


def exposures(texts: DataFrame, key: str, voices: list[str], profiles: list[tuple[str, int]], seed: int = 1234) -> DataFrame:
    """Every text in every round: a clean round per voice, then an augmented one per profile (id, round) with rotating voices."""
    spark = texts.sparkSession
    placed = global_rank(texts.select(F.col(key).alias("semantic_key")), F.sha2(F.col("semantic_key").cast("string"), 256), F.col("semantic_key"), name="semantic_position")
    rounds = [(i + 1, "clean", "clean", i, True) for i in range(len(voices))] + [(r, "augmented", p, i, False) for i, (p, r) in enumerate(profiles)]
    table = spark.createDataFrame(rounds, "round int, view_type string, profile_id string, shift int, clean boolean")
    both = placed.crossJoin(F.broadcast(table))  # a row per round on the small side
    turn = F.when(F.col("clean"), F.col("shift")).otherwise(F.pmod(F.col("semantic_position") + F.col("shift"), F.lit(len(voices))))
    return both.select(
        "round",
        "semantic_position",
        "semantic_key",
        "view_type",
        F.element_at(F.array(*(F.lit(v) for v in voices)), (turn + 1).cast("int")).alias("voice"),
        "profile_id",
        (~F.col("clean") & (F.pmod(F.col("semantic_position") + F.col("shift"), F.lit(2)) == 0)).alias("spec_augment"),
        F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("semantic_position").cast("string")), 256).alias("batch_order_seed"),
    )


def rotation(records: DataFrame, key: str, profiles: list[str], epochs: int) -> DataFrame:
    """A latin square: each record meets the profiles in turn, starting at its place by hash."""
    n = len(profiles)
    placed = global_rank(records.select(key), F.sha2(F.col(key).cast("string"), 256), F.col(key))
    every = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    index = F.pmod(F.col("pos") + F.col("epoch") - 1, F.lit(n)).cast("int")
    return every.select("epoch", key, index.alias("profile_index"), F.element_at(F.array(*(F.lit(p) for p in profiles)), index + 1).alias("profile_id"))


def group_rotation(records: DataFrame, key: str, voices: list[str], epochs: int, group: int = 20) -> DataFrame:
    """epoch, key, voice: groups of `group` records, in the order of their hashes, take the voices in turn."""
    placed = global_rank(records.select(key), F.sha2(F.col(key).cast("string"), 256), F.col(key))
    every = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    turn = F.pmod(F.floor(F.col("pos") / group) + F.col("epoch") - 1, F.lit(len(voices))).cast("int")
    return every.select("epoch", key, F.element_at(F.array(*(F.lit(v) for v in voices)), turn + 1).alias("voice"))


def exhausted(attempts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """exceeded: the budgets that are used up. attempts: cell, shard, requested; limits: total_attempts, requested_rows, cell and shard (each)."""
    all_ = attempts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("requested"), F.lit(0)).alias("rows"))
    whole = [("total_attempts", "n"), ("requested_rows", "rows")]
    out = all_.select(F.explode(F.array_compact(F.array(*(F.when(F.col(c) >= limits[name], F.lit(name)) for name, c in whole if name in limits), F.lit(None).cast("string")))).alias("exceeded"))
    for by in ("cell", "shard"):
        if by in limits:
            over = attempts.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limits[by])
            out = out.unionAll(over.select(F.concat(F.lit(f"{by}:"), F.col(by).cast("string")).alias("exceeded")))
    return out


def balance(schedule: DataFrame, *by: str) -> DataFrame:
    """Rows by group, with the spread between the fullest and the emptiest group beside them."""
    counts = schedule.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.agg((F.max("n") - F.min("n")).alias("spread"))
    return counts.crossJoin(F.broadcast(spread))


def _between(low: float, high: float, unit: Column) -> Column:
    return F.round(F.lit(low) + (F.lit(high) - F.lit(low)) * unit, 6)


#: What each profile draws: name, the parameters' bounds (minimum and maximum, or options), and whether it uses 1 - unit.
DRAWS: dict[str, list[tuple[str, tuple[str, str] | str, bool]]] = {
    "coupled_speed_pitch_resampling": [("rate", "rates", False)],
    "tempo_preserving_pitch": [("tempo_factor", ("minimum_factor", "maximum_factor"), False)],
    "mild_pitch_formant_vtlp_proxy": [("pitch_semitones", ("minimum_semitones", "maximum_semitones"), False), ("formant_warp", ("minimum_warp", "maximum_warp"), True)],
    "procedural_room_impulse_response": [("rt60_seconds", ("minimum_rt60_seconds", "maximum_rt60_seconds"), False)],
    "environmental_background_noise": [("snr_db", ("minimum_snr_db", "maximum_snr_db"), False)],
    "coloured_electrical_noise": [("snr_db", ("minimum_snr_db", "maximum_snr_db"), False)],
    "compound_realistic_condition": [("snr_db", ("minimum_snr_db", "maximum_snr_db"), False)],
    "microphone_channel_filtering": [("filter", "filters", False)],
    "codec_sample_rate_simulation": [("codec", "codecs", False)],
    "gain_dynamic_range_variation": [("gain_db", ("minimum_gain_db", "maximum_gain_db"), False), ("peak_safety", "peak_safety", False)],
    "timing_silence_variation": [("leading_silence_seconds", ("", "maximum_leading_silence_seconds"), False), ("trailing_silence_seconds", ("", "maximum_trailing_silence_seconds"), True), ("time_shift_seconds", ("-maximum_time_shift_seconds", "maximum_time_shift_seconds"), False)],
}


def parameters(profile: str, given: dict, key: Column) -> Column:
    """map<string,string> of the parameters a key draws for a profile."""
    if profile not in DRAWS:
        raise ValueError(f"unknown profile {profile}")
    unit = unit_interval(key, F.lit(profile))
    bound = lambda name: 0.0 if not name else -given[name[1:]] if name.startswith("-") else given[name]
    cells: list[Column] = []
    for name, source, back in DRAWS[profile]:
        if isinstance(source, tuple):
            value = _between(bound(source[0]), bound(source[1]), 1 - unit if back else unit).cast("string")
        elif isinstance(given[source], (list, tuple)):
            value = chosen(F.array(*(F.lit(str(o)) for o in given[source])), key, F.lit(profile))
        else:
            value = F.lit(str(given[source]))
        cells += [F.lit(name), value]
    return F.create_map(*cells)


def controls_by_rate(df: DataFrame, key: str, rate: str, seed: int, count: int) -> DataFrame:
    """`count` rows by the hash of seed, key and rate (rounded to three digits and written as a float is)."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.round(rate, 3).cast("string")), 256)
    return df.orderBy(order, key).limit(count)


def storage(inherited_bytes: int, available_bytes: int, margin: float = 0.25) -> dict:
    """Whether three times the inherited bytes fit with a margin."""
    if inherited_bytes <= 0:
        raise ValueError("there is nothing to estimate from")
    new = 3 * inherited_bytes
    needed = int(new * (1 + margin))
    return {"projected_new_bytes": new, "required_free_bytes": needed, "sufficient": available_bytes >= needed}
