import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import decisions, schedules


def test_batches_and_padding(spark):
    df = spark.createDataFrame([("c", 3.0), ("a", 1.0), ("b", 2.0)], "id string, duration double")
    laid = schedules.batches(df, 2, F.col("duration"), F.col("id"))
    assert {r["id"]: r["batch"] for r in laid.collect()} == {"a": 0, "b": 0, "c": 1}
    got = schedules.padding(laid, "duration", 2).first()
    assert (got["padded"], got["actual"], got["final_partial"]) == (7.0, 6.0, 1)


def test_epoch_order(spark):
    want = list(range(9))
    random.Random(7 + 2).shuffle(want)
    assert [r["batch"] for r in schedules.epoch_order(spark, 9, 7, 2).orderBy("place").collect()] == want


def test_exposures(spark):
    out = schedules.exposures(spark.range(10), "id", ["v1", "v2", "v3"], [("p", 4), ("q", 5)])
    assert out.count() == 50 and out.groupBy("round").agg(F.count_distinct("semantic_key").alias("n")).where("n <> 10").count() == 0
    order = sorted(range(10), key=lambda i: (hashlib.sha256(str(i).encode()).hexdigest(), i))
    row = out.where(f"round = 5 and semantic_key = {order[4]}").first()
    assert (row["semantic_position"], row["voice"], row["spec_augment"], row["profile_id"]) == (4, "v3", False, "q")
    assert row["batch_order_seed"] == hashlib.sha256(b"1234:5:4").hexdigest()


def test_rotation_is_balanced(spark):
    out = schedules.rotation(spark.range(12), "id", ["a", "b", "c"], 3)
    assert schedules.balance(out, "epoch", "profile_id").where("spread <> 0").count() == 0
    assert out.groupBy("id").agg(F.count_distinct("profile_id").alias("n")).where("n <> 3").count() == 0


@pytest.mark.parametrize("profile,given,names", [("tempo_preserving_pitch", {"minimum_factor": 0.9, "maximum_factor": 1.1}, ["tempo_factor"]), ("codec_sample_rate_simulation", {"codecs": ["x", "y"]}, ["codec"]), ("timing_silence_variation", {"maximum_leading_silence_seconds": 0.2, "maximum_trailing_silence_seconds": 0.3, "maximum_time_shift_seconds": 0.05}, ["leading_silence_seconds", "time_shift_seconds", "trailing_silence_seconds"])])
def test_parameters(spark, profile, given, names):
    got = spark.range(1).select(schedules.parameters(profile, given, F.lit("k")).alias("p")).first()["p"]
    assert sorted(got) == names
    unit = int(hashlib.sha256(f"k:{profile}".encode()).hexdigest()[:12], 16) / 0xFFFFFFFFFFFF
    if profile == "tempo_preserving_pitch":
        assert float(got["tempo_factor"]) == pytest.approx(0.9 + 0.2 * unit, abs=1e-6)
    with pytest.raises(ValueError):
        schedules.parameters("unknown", {}, F.lit("k"))


def test_controls_and_storage(spark):
    df = spark.createDataFrame([(f"c{i}", i / 8) for i in range(20)], "id string, wer double")
    want = sorted((f"c{i}" for i in range(20)), key=lambda c: hashlib.sha256(f"3:{c}:{round(int(c[1:]) / 8, 3)}".encode()).hexdigest())[:5]
    assert [r["id"] for r in schedules.controls_by_rate(df, "id", "wer", 3, 5).collect()] == want
    assert schedules.storage(100, 375)["sufficient"] and not schedules.storage(100, 374)["sufficient"]


def test_larger_batch(spark):
    arm = "struct<status: string, parity_eligible: boolean, peak_memory_mib: double, throughput: double>"
    df = spark.createDataFrame([(("PASSED", True, 10.0, 60.0), ("PASSED", True, 5.0, 50.0)), (("PASSED", True, 99.0, 60.0), ("PASSED", True, 5.0, 50.0)), (("OOM", None, None, None), ("PASSED", True, 5.0, 50.0))], f"a {arm}, b {arm}")
    assert [r["x"] for r in df.select(decisions.worth_larger_batch("a", "b", 50.0, 1.1).alias("x")).collect()] == [True, False, False]
