"""Golden numbers and labels of the decision rules."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import decisions as d

SYNTHETIC = ("piper_synthetic_holdout", "supertonic_heldout_voice_holdout")
BASE = {"fleurs_v2": (52.685, 16.406, 1), "artur_j": (67.322, 28.620, 12), SYNTHETIC[0]: (60.0, 20.0, 0), SYNTHETIC[1]: (60.0, 20.0, 0)}


def frame(spark, table, model=None):
    rows = [(s, *map(float, v[:2]), v[2]) for s, v in table.items()]
    df = spark.createDataFrame(rows, "split string, wer double, cer double, empty int")
    return df.withColumn("model", F.lit(model)) if model else df


def moved(dw, dc=None, empty=0, synthetic=-1.0):
    return {s: (w + (dw if s not in SYNTHETIC else synthetic), c + ((dw if dc is None else dc) if s not in SYNTHETIC else synthetic), empty) for s, (w, c, _) in BASE.items()}


@pytest.mark.parametrize("rates,want", [((64.733, 25.529, 72.958, 30.021), 28.208), ((60.616, 20.973, 70.511, 26.723), 15.687), ((58.643, 19.023, 68.283, 24.926), 9.536)])
def test_burden(spark, rates, want):
    m = {"fleurs_v2": (*rates[:2], 0), "artur_j": (*rates[2:], 0)}
    assert d.facts(frame(spark, m, "m"), frame(spark, BASE)).first()["burden"] == pytest.approx(want, abs=1e-6)


def test_facts(spark):
    better = d.facts(frame(spark, moved(-2.0), "m"), frame(spark, BASE), prior=frame(spark, moved(-1.9))).first()
    assert better["non_regression"] and better["improvement"] and better["all_better"] and better["synthetic_safe"] and better["burden"] == 0 and better["prior_better"] == 4 and better["prior_all_better"]
    worse = d.facts(frame(spark, moved(1.2, 0.1, empty=99), "m"), frame(spark, BASE), prior=frame(spark, moved(0.0))).first()
    assert not worse["non_regression"] and worse["catastrophic"] and not worse["empty_ok"] and not worse["no_empty"] and worse["prior_better"] == 0 and not worse["prior_within_loose"]


@pytest.mark.parametrize(
    "rule,change,extra,want",
    [
        ("scale2000", moved(-2.0), {}, "SCALE2000_TEXT_REAL_GAIN_DIRECTIONAL"),
        ("scale2000", moved(2.0), {}, "SCALE2000_TEXT_DEGRADES"),
        ("scale8000_clean", moved(-2.0), {}, "SCALE8000_CLEAN_BEATS_SCALE2000_AUGMENTED_DIRECTIONAL"),
        ("scale8000_clean", moved(-0.5), {}, "SCALE8000_CLEAN_BEATS_BASE_BUT_NOT_SCALE2000"),
        ("decoder_joint", moved(0.2), {}, "DECODER_JOINT_RNNT_SYNTHETIC_ONLY_OR_REGRESSES"),
        ("hardvoice", moved(-2.0), {"s6_gain": True, "s6_beats_pr36": None}, "S6TTS_HARDVOICE_IMPACT_POSITIVE_REAL_SAFE"),
        ("hardvoice", moved(1.0), {"s6_gain": False, "s6_beats_pr36": None}, "S6TTS_HARDVOICE_REAL_REGRESSION"),
        ("artur_earlystop", moved(-2.0), {"selected_round": 7, "max_round": 20}, "ARTUR_EARLYSTOP_FINDS_EFFICIENT_EARLIER_CHECKPOINT"),
        ("artur_earlystop", moved(-2.0), {"selected_round": None, "max_round": 20}, "ARTUR_EARLYSTOP_NO_REAL_DEV_GAIN"),
        ("speaker_range", moved(0.5), {"holdout_gain": True, "clean_burden": 9.0}, "SPEAKER_RANGE_AUGMENTATION_PREVENTS_REAL_REGRESSION"),
        ("text_only", moved(-0.5), {"text_validation_improved": True}, "TEXT_ONLY_DECODER_LM_REAL_GAIN_DIRECTIONAL"),
        ("text_only", moved(1.2), {"text_validation_improved": True}, "TEXT_ONLY_DECODER_LM_DEGRADES_ASR"),
        ("round1", moved(-1.2), {"integrity": True, "synthetic_relative_gain": 20.0}, "ROUND1_REJECTED"),
        ("round1", moved(-1.6), {"integrity": True, "synthetic_relative_gain": 20.0}, "ROUND1_ACCEPTED_REAL_GENERALIZATION"),
        ("surface04", moved(-2.0), {"integrity": True, "selected_round": 5}, "SURFACE04_BEATS_PR36_DIRECTIONAL"),
        ("surface05", moved(-2.0), {"integrity": True, "selected_round": 5, "improves_prior": True}, "SURFACE05_NEW_BEST_DIRECTIONAL_CANDIDATE"),
        ("surface06", moved(-2.0, synthetic=1.0), {"integrity": True, "selected_round": 5, "improves_prior": True}, "SURFACE06_SYNTHETIC_OR_REAL_REGRESSION"),
        ("surface07", moved(-2.0), {"integrity": True, "selected_round": 5, "bridge_proven": False}, "BLOCKED_FUSION_BRIDGE_UNRESOLVED"),
        ("surface08", moved(-2.0, empty=1), {"integrity": True, "selected_round": 5}, "SURFACE08_SYNTHETIC_OVERFIT_OR_REAL_REGRESSION"),
        ("surface08", moved(-2.0), {"integrity": False, "selected_round": 5}, "EXPERIMENT_INVALID"),
    ],
)
def test_labels(spark, rule, change, extra, want):
    if rule == "round1" and want == "ROUND1_REJECTED":
        extra = extra | {"synthetic_relative_gain": 3.0}
    prior = frame(spark, moved(-1.6))
    row = d.facts(frame(spark, change, "m"), frame(spark, BASE), scale200=prior, scale2000=prior, pr36=prior, clean=prior, envelope=prior)
    kinds = {"s6_beats_pr36": "boolean", "selected_round": "int"}
    row = row.withColumns({k: F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v) for k, v in extra.items()})
    assert row.select(d.label(rule).alias("x")).first()["x"] == want


def test_the_remaining_rules_have_a_last_word(spark):
    for rule, parts in d.RULES.items():
        assert parts[-1][0] == "true" or rule == "canonical", rule
    one = spark.range(1).selectExpr("false AS real_gain", "true AS synthetic_gain_10", "true AS integrity", "1.0D AS reference_speed", "1.3D AS batched_speed", "true AS equivalent", "8 AS selected_batch", "true AS exact_parity", "1.1D AS speedup")
    got = one.select(*(d.label(r).alias(r) for r in ("scientific", "batching", "streaming_batches"))).first()
    assert tuple(got) == ("CORPUS_V2_PROMPT_COLUMN_SYNTHETIC_ONLY", "A100_PROMPT_TRAINING_BATCH_SUPPORTED", "A100_BATCHED_STREAMING_EQUIVALENT_NO_MATERIAL_GAIN")


def test_promotion_and_policies(spark):
    row = spark.range(1).selectExpr("true AS integrity", "20.0D AS synthetic_wer_gain", "1.0D AS synthetic_cer_gain", "1.5D AS wer_delta", "0.0D AS cer_delta", "1 AS empty_delta")
    assert len(row.select(d.promotion_reasons().alias("r")).first()["r"]) == 2
    arms = spark.createDataFrame([(1, False, 10.0, True), (8, True, 48.0, True), (32, True, 50.0, True), (64, True, 90.0, False)], "batch_size int, bucketed boolean, throughput double, parity_eligible boolean")
    assert d.batch_policy(arms, 0.95).first()["batch_size"] == 8
    assert tuple(d.batch_policy(arms.where("false"), 0.95).first())[:2] == (1, True)
    outcomes = spark.createDataFrame([(4, "OOM"), (2, "PASSED"), (1, "PASSED")], "candidate int, outcome string")
    assert d.first_passed(outcomes, (4, 2, 1)).first()["candidate"] == 2
    issues = spark.createDataFrame([("a", "review_required"), ("a", "blocked"), ("b", "other")], "c string, s string")
    assert {tuple(r) for r in issues.groupBy("c").agg(d.worst_status(F.col("s"))).collect()} == {("a", "BLOCKED"), ("b", "PASSED")}
