"""Decision rules: a table of rates by model and split becomes facts by model, and facts become labels.

facts() makes one pass: each model's rates beside those of the base and of further comparators, then one aggregate per
model. A rule is a list of conditions over facts with their labels; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split names, tolerances, labels and reasons of the decision contract.
REAL = ("fleurs_v2", "artur_j")
#: Rates may be worse than a comparator's by so much: tolerance and loose tolerance of wer and cer.
TOLERANCE = {"wer": 0.50, "cer": 0.25}
LOOSE = {"wer": 0.75, "cer": 0.35}
NON_REGRESSION = {"wer": 1.0, "cer": 1.5}


def facts(metrics: DataFrame, base: DataFrame, **comparators: DataFrame) -> DataFrame:
    """One row per model. metrics: model, split, wer, cer, empty; base and comparators: split, wer, cer, empty (few rows, one per split).

    Columns against the base: burden, non_regression, improvement, any_better, all_better, none_worse, within_quarter,
    catastrophic, empty_ok, no_empty, piper_gain, supertonic_gain, synthetic_gain, synthetic_safe. Against comparator c:
    c_better (number of real rates), c_all_better, c_within_tolerance, c_within_loose, c_none_half_worse, c_within_half, c_none_one_worse,
    c_synthetic_none_one_worse, c_synthetic_within_one, c_empty_ok, c_fleurs_within, c_artur_better."""
    rows = metrics
    for name, other in {"base": base, **comparators}.items():
        rows = rows.join(F.broadcast(other.select("split", *(F.col(m).alias(f"{name}_{m}") for m in ("wer", "cer", "empty")))), "split", "left")
    real, both = F.col("split").isin(*REAL), ("wer", "cer")
    synthetic = ~real
    all_ = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))

    def of(name: str, metric: str) -> Column:
        return F.col(metric) - F.col(f"{name}_{metric}")

    def every(where: Column, name: str, most: dict[str, float] | float, strict: bool = False) -> Column:
        limit = most if isinstance(most, dict) else dict.fromkeys(both, most)
        ok = F.lit(True)
        for m in both:
            ok = ok & (of(name, m) < limit[m] if strict else of(name, m) <= limit[m])
        return all_(F.when(where, ok))

    def some(where: Column, name: str, most: dict[str, float] | float, strict: bool = True) -> Column:
        limit = most if isinstance(most, dict) else dict.fromkeys(both, most)
        hit = F.lit(False)
        for m in both:
            hit = hit | (of(name, m) < limit[m] if strict else of(name, m) <= limit[m])
        return any_(F.when(where, hit))

    empty_ok = lambda name: all_(F.when(real, F.col("empty") <= F.col(f"{name}_empty")))
    worse = sum((F.greatest(F.lit(0.0), of("base", m)) for m in both), F.lit(0.0))
    out = {
        "burden": F.round(F.sum(F.when(real, worse).otherwise(0.0)), 6),
        "empty_ok": empty_ok("base"),
        "no_empty": all_(F.when(real, F.col("empty") == 0)),
        "rates_ok": every(real, "base", NON_REGRESSION),
        "improvement": some(real, "base", {m: -v for m, v in NON_REGRESSION.items()}, strict=False),
        "any_better": some(real, "base", 0.0),
        "all_better": every(real, "base", 0.0, strict=True),
        "none_worse": every(real, "base", 0.0),
        "within_quarter": every(real, "base", 0.25),
        "rates_within_one": every(real, "base", 1.0),
        "piper_gain": some(F.col("split") == "piper_synthetic_holdout", "base", 0.0),
        "supertonic_gain": some(F.col("split") == "supertonic_heldout_voice_holdout", "base", 0.0),
        "synthetic_gain": some(synthetic, "base", 0.0),
        "synthetic_safe": every(synthetic, "base", 0.0, strict=True),
    }
    for c in comparators:
        inside = lambda most, c=c: (F.abs(of(c, "wer")) <= most) & (F.abs(of(c, "cer")) <= most)
        out |= {
            f"{c}_better": F.sum(F.when(real, sum(((of(c, m) < 0).cast("int") for m in both), F.lit(0))).otherwise(0)),
            f"{c}_all_better": every(real, c, 0.0, strict=True),
            f"{c}_within_tolerance": every(real, c, TOLERANCE),
            f"{c}_within_loose": every(real, c, LOOSE),
            f"{c}_none_half_worse": every(real, c, 0.5),
            f"{c}_within_half": all_(F.when(real, inside(0.5))),
            f"{c}_none_one_worse": every(real, c, 1.0),
            f"{c}_synthetic_none_one_worse": every(synthetic, c, 1.0),
            f"{c}_synthetic_within_one": all_(F.when(synthetic, inside(1.0))),
            f"{c}_empty_ok": empty_ok(c),
            f"{c}_fleurs_within": every(F.col("split") == "fleurs_v2", c, TOLERANCE),
            f"{c}_artur_better": some(F.col("split") == "artur_j", c, 0.0),
        }
    done = rows.groupBy("model").agg(*(v.alias(k) for k, v in out.items()))
    return done.withColumns({"non_regression": F.col("rates_ok") & F.col("empty_ok"), "catastrophic": ~(F.col("rates_within_one") & F.col("empty_ok"))}).drop("rates_ok", "rates_within_one")


def _unpivoted(metrics: DataFrame, name: str, *keep: str) -> DataFrame:
    """keep, split, metric and the value as `name`: a row for each rate on the real splits."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(TOLERANCE[m]).alias("tolerance"), F.col(m).alias("value")) for m in TOLERANCE)))
    return metrics.where(F.col("split").isin(*REAL)).select(*keep, "split", cells.alias("c")).select(*keep, "split", "c.metric", "c.tolerance", F.col("c.value").alias(name))


def votes(metrics: DataFrame, rivals: DataFrame, most: int = 3) -> DataFrame:
    """model, prior_count, best_count, within_best, prior_stronger: each model against the earlier ones, over both rates of both real splits.

    best_count: rates better than the best earlier one; within_best: none worse than it by more than its tolerance; prior_stronger:
    one earlier model alone is better in `most` rates. Without earlier models there is nothing to be worse than."""
    own = _unpivoted(metrics, "value", "model")
    others = _unpivoted(rivals.withColumnRenamed("model", "rival"), "prior", "rival").drop("tolerance")
    best = others.groupBy("split", "metric").agg(F.min("prior").alias("best"))
    counted = own.join(best, ["split", "metric"], "left").groupBy("model").agg(
        F.count_if(F.col("value") < F.col("best")).alias("best_count"), F.coalesce(F.every(F.col("value") <= F.col("best") + F.col("tolerance")), F.lit(True)).alias("within_best")
    )
    wins = own.join(others, ["split", "metric"]).groupBy("model", "rival").agg(F.count_if(F.col("prior") < F.col("value")).alias("wins"))
    wins = wins.groupBy("model").agg(F.count(F.lit(1)).alias("prior_count"), (F.max("wins") >= most).alias("prior_stronger"))
    out = counted.join(wins, "model", "left")
    return out.select("model", F.coalesce("prior_count", F.lit(0)).alias("prior_count"), "best_count", "within_best", F.coalesce("prior_stronger", F.lit(False)).alias("prior_stronger"))


def relative_gains(metrics: DataFrame, base: DataFrame, split: str, least: float = 10.0) -> DataFrame:
    """model, wer_relative_gain, cer_relative_gain (percent of the base's rate on a split; none of a base of 0) and whether one is at least `least`."""
    of = base.where(F.col("split") == split).select(F.col("wer").alias("__wer"), F.col("cer").alias("__cer"))  # one row
    gain = lambda m: F.when(F.col(f"__{m}") != 0, (F.col(f"__{m}") - F.col(m)) / F.nullif(F.col(f"__{m}"), F.lit(0.0)) * 100).otherwise(0.0)
    rows = metrics.where(F.col("split") == split).join(F.broadcast(of), F.lit(True))
    return rows.select("model", F.round(gain("wer"), 6).alias("wer_relative_gain"), F.round(gain("cer"), 6).alias("cer_relative_gain"), ((gain("wer") >= least) | (gain("cer") >= least)).alias("passes"))


def equivalence(metrics: DataFrame, reference: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """model and equivalent: both rates of every split within its tolerance of the reference's, and as many empties on the real ones."""
    limit = F.create_map(*(x for k, v in tolerances.items() for x in (F.lit(k), F.lit(v))))
    other = reference.select("split", *(F.col(c).alias(f"__{c}") for c in ("wer", "cer", "empty")))
    rows = metrics.where(F.col("split").isin(*tolerances)).join(other, "split")
    near = lambda m: F.abs(F.col(m) - F.col(f"__{m}")) <= limit[F.col("split")]
    same = ~F.col("split").isin(*REAL) | (F.col("empty") == F.col("__empty"))
    return rows.groupBy("model").agg(F.every(near("wer") & near("cer") & same).alias("equivalent"))


def arms(facts: DataFrame, gains: DataFrame, experiment: str, arm: Column) -> DataFrame:
    """experiment and label of the rule "scientific": what any valid arm of an experiment shows. facts: model, experiment, non_regression, improvement; gains: model, passes."""
    rows = facts.where(arm).join(gains.select("model", "passes"), "model")
    seen = rows.groupBy(experiment).agg(F.some(F.col("non_regression") & F.col("improvement")).alias("real_gain"), F.some("passes").alias("synthetic_gain_10"))
    every = facts.select(experiment).distinct().join(seen, experiment, "left").fillna(False, ["real_gain", "synthetic_gain_10"])
    return every.select(experiment, "real_gain", F.col("synthetic_gain_10").alias("synthetic_gain"), label("scientific").alias("label"))


def _against_prior(name: str, c: str, beats: str, matches: str, base_only: str, otherwise: str) -> list[tuple[str, str]]:
    gains = "piper_gain AND supertonic_gain AND burden = 0"
    return [
        (f"{gains} AND {c}_better >= 2 AND {c}_none_half_worse AND {c}_synthetic_none_one_worse", f"{name}_{beats}"),
        (f"{gains} AND {c}_within_half AND {c}_synthetic_within_one", f"{name}_{matches}"),
        (gains, f"{name}_{base_only}"),
        ("true", f"{name}_{otherwise}"),
    ]


#: Conditions over facts, further columns named beside each rule, and labels; the first condition that holds decides.
RULES: dict[str, list[tuple[str, str]]] = {
    # comparator scale200
    "scale2000": [
        ("piper_gain AND supertonic_gain AND non_regression AND improvement", "SCALE2000_TEXT_REAL_GAIN_DIRECTIONAL"),
        ("piper_gain AND supertonic_gain AND burden <= 2.0076 AND burden <= 2.868 * 0.7 AND scale200_none_half_worse", "SCALE2000_TEXT_IMPROVES_SCALE200"),
        ("piper_gain AND supertonic_gain AND burden BETWEEN 2.0076 AND 3.7284 AND NOT non_regression", "SCALE2000_TEXT_PLATEAUS"),
        ("NOT piper_gain OR NOT supertonic_gain OR burden > 3.7284 OR NOT (scale200_none_one_worse OR improvement)", "SCALE2000_TEXT_DEGRADES"),
        ("true", "EXPERIMENT_INVALID"),
    ],
    # comparator scale2000
    "scale8000_clean": _against_prior("SCALE8000_CLEAN", "scale2000", "BEATS_SCALE2000_AUGMENTED_DIRECTIONAL", "MATCHES_SCALE2000_AUGMENTED_DIRECTIONAL", "BEATS_BASE_BUT_NOT_SCALE2000", "UNDERPERFORMS_DIRECTIONALLY"),
    "decoder_joint": _against_prior("DECODER_JOINT_RNNT", "scale2000", "BEATS_SCALE2000_DIRECTIONAL", "MATCHES_SCALE2000_DIRECTIONAL", "BEATS_BASE_BUT_NOT_SCALE2000", "SYNTHETIC_ONLY_OR_REGRESSES"),
    # comparator pr36; column s6_gain (both synthetic views better), s6_beats_pr36 (null if not compared)
    "hardvoice": [
        ("s6_gain AND none_worse AND pr36_within_loose AND pr36_empty_ok AND coalesce(s6_beats_pr36, true)", "S6TTS_HARDVOICE_IMPACT_POSITIVE_REAL_SAFE"),
        ("s6_gain AND none_worse", "S6TTS_HARDVOICE_IMPROVES_S6_SYNTHETIC_ONLY"),
        ("NOT none_worse OR NOT empty_ok", "S6TTS_HARDVOICE_REAL_REGRESSION"),
        ("true", "S6TTS_HARDVOICE_NO_S6_GAIN"),
    ],
    # comparator pr36; columns selected_round, max_round
    "artur_earlystop": [
        ("coalesce(selected_round, 0) = 0", "ARTUR_EARLYSTOP_NO_REAL_DEV_GAIN"),
        ("selected_round >= max_round", "ARTUR_EARLYSTOP_SELECTS_ROUND20_OR_MAXROUND"),
        ("burden IS NULL OR burden = 0 AND pr36_within_loose", "ARTUR_EARLYSTOP_FINDS_EFFICIENT_EARLIER_CHECKPOINT"),
        ("true", "ARTUR_EARLYSTOP_SELECTED_CHECKPOINT_DIRECTIONAL_REGRESSES"),
    ],
    # comparator clean; columns holdout_gain (ten percent on the holdout), clean_burden
    "speaker_range": [
        ("holdout_gain AND non_regression", "SPEAKER_RANGE_AUGMENTATION_PREVENTS_REAL_REGRESSION"),
        ("holdout_gain AND coalesce((clean_burden - burden) / nullif(clean_burden, 0) * 100, 0) >= 30 AND clean_none_half_worse", "SPEAKER_RANGE_AUGMENTATION_MITIGATES_REAL_REGRESSION"),
        ("true", "SPEAKER_RANGE_AUGMENTATION_NOT_SUPPORTED"),
    ],
    # column text_validation_improved
    "text_only": [
        ("burden = 0 AND any_better AND within_quarter AND empty_ok", "TEXT_ONLY_DECODER_LM_REAL_GAIN_DIRECTIONAL"),
        ("catastrophic", "TEXT_ONLY_DECODER_LM_DEGRADES_ASR"),
        ("synthetic_gain AND burden > 0", "TEXT_ONLY_DECODER_LM_HELPS_SYNTHETIC_ONLY"),
        ("text_validation_improved", "TEXT_ONLY_DECODER_LM_NO_ASR_GAIN"),
        ("true", "TEXT_ONLY_DECODER_LM_DEGRADES_ASR"),
    ],
    # columns of all arms together: real_gain (an arm without regression improves), synthetic_gain_10
    "scientific": [
        ("real_gain", "CORPUS_V2_PROMPT_COLUMN_REAL_GAIN_DIAGNOSTIC"),
        ("synthetic_gain_10", "CORPUS_V2_PROMPT_COLUMN_SYNTHETIC_ONLY"),
        ("true", "CORPUS_V2_PROMPT_COLUMN_NOT_SUPPORTED"),
    ],
    # columns integrity (null without a batched run), reference_speed, batched_speed, equivalent
    "batching": [
        ("integrity IS NULL", "A100_PROMPT_TRAINING_BATCH_UNAVAILABLE"),
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("reference_speed > 0 AND batched_speed >= reference_speed * 1.25 AND equivalent", "A100_PROMPT_TRAINING_BATCH_SUPPORTED"),
        ("true", "A100_PROMPT_TRAINING_BATCH_NOT_EQUIVALENT"),
    ],
    # columns selected_batch, exact_parity, speedup
    "streaming_batches": [
        ("selected_batch > 1 AND exact_parity AND speedup >= 1.25", "A100_BATCHED_STREAMING_SUPPORTED"),
        ("exact_parity", "A100_BATCHED_STREAMING_EQUIVALENT_NO_MATERIAL_GAIN"),
        ("true", "A100_BATCHED_STREAMING_NOT_EQUIVALENT"),
    ],
    # comparator surface07; comparators' votes as columns prior_count, best_count, within_best, prior_stronger
    "canonical": [
        ("NOT all_better OR NOT empty_ok", "CANONICAL_REJECTS_SURFACE07_DIRECTIONAL_GAIN"),
        ("prior_count = 0 OR best_count >= 3 AND within_best", "CANONICAL_SURFACE07_CONFIRMED_NEW_BEST"),
        ("prior_stronger", "CANONICAL_SURFACE06_OR_PRIOR_STRONGER"),
        ("true", "CANONICAL_SURFACE07_CONFIRMED_BUT_MIXED"),
    ],
    # of all models together: columns replay_safe, replay_improvement, replay_gain, canonical_gain, canonical_safe, replay_reduction, canonical_reduction
    "directional": [
        ("replay_safe AND replay_improvement AND replay_gain", "FAST_DIRECTIONAL_REPLAY_CHANGES_CONCLUSION_POSITIVELY"),
        ("NOT replay_gain OR replay_reduction < 20", "FAST_DIRECTIONAL_REPLAY_CHANGES_CONCLUSION_NEGATIVELY"),
        ("canonical_gain AND canonical_reduction >= 20 AND NOT canonical_safe AND NOT replay_safe", "FAST_DIRECTIONAL_REPLAY_CONFIRMS_CONCLUSION"),
        ("true", "FAST_DIRECTIONAL_REPLAY_INCONCLUSIVE"),
    ],
    # columns integrity, synthetic_relative_gain; thresholds of the first round
    "round1": [
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT non_regression OR synthetic_relative_gain < 15", "ROUND1_REJECTED"),
        ("improvement", "ROUND1_ACCEPTED_REAL_GENERALIZATION"),
        ("true", "ROUND1_SYNTHETIC_ONLY"),
    ],
    # comparators pr36; columns integrity, selected_round
    "surface04": [
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT no_empty", "SURFACE04_SYNTHETIC_OR_REAL_REGRESSION"),
        ("pr36_all_better AND synthetic_safe", "SURFACE04_BEATS_PR36_DIRECTIONAL"),
        ("pr36_within_tolerance AND pr36_better > 0 AND synthetic_safe", "SURFACE04_MATCHES_PR36_WITH_ACCEPTABLE_TRADEOFF"),
        ("all_better", "SURFACE04_BEATS_BASE_BUT_NOT_PR36"),
        ("selected_round > 0", "SURFACE04_ARTUR_DEV_GOOD_BUT_GATE_DIRECTIONAL_REGRESSES"),
        ("true", "SURFACE04_SYNTHETIC_OR_REAL_REGRESSION"),
    ],
    # comparator envelope (the best earlier rates); columns integrity, selected_round, improves_prior (better than some challenger somewhere)
    "surface05": [
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT no_empty", "SURFACE05_SYNTHETIC_OR_REAL_REGRESSION"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 3", "SURFACE05_NEW_BEST_DIRECTIONAL_CANDIDATE"),
        ("synthetic_safe AND envelope_within_tolerance AND improves_prior", "SURFACE05_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"),
        ("synthetic_safe AND all_better", "SURFACE05_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"),
        ("selected_round > 0", "SURFACE05_ARTUR_DEV_GOOD_BUT_GATE_DIRECTIONAL_REGRESSES"),
        ("true", "SURFACE05_SYNTHETIC_OR_REAL_REGRESSION"),
    ],
    "surface06": [
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT no_empty", "SURFACE06_SYNTHETIC_OR_REAL_REGRESSION"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 3", "SURFACE06_NEW_BEST_DIRECTIONAL_CANDIDATE"),
        ("synthetic_safe AND envelope_within_tolerance AND improves_prior", "SURFACE06_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"),
        ("selected_round > 0 AND envelope_artur_better AND NOT envelope_fleurs_within", "SURFACE06_ARTUR_DEV_GOOD_BUT_FLEURS_REGRESSES"),
        ("synthetic_safe AND all_better", "SURFACE06_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"),
        ("true", "SURFACE06_SYNTHETIC_OR_REAL_REGRESSION"),
    ],
    # further column bridge_proven
    "surface07": [
        ("NOT bridge_proven", "BLOCKED_FUSION_BRIDGE_UNRESOLVED"),
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT no_empty", "SURFACE07_SYNTHETIC_OR_REAL_REGRESSION"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 3", "SURFACE07_NEW_BEST_DIRECTIONAL_CANDIDATE"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 1", "SURFACE07_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"),
        ("selected_round > 0 AND envelope_artur_better AND NOT envelope_fleurs_within", "SURFACE07_FUSION_GOOD_BUT_FLEURS_REGRESSES"),
        ("synthetic_safe AND all_better", "SURFACE07_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"),
        ("true", "SURFACE07_SYNTHETIC_OR_REAL_REGRESSION"),
    ],
    "surface08": [
        ("NOT integrity", "EXPERIMENT_INVALID"),
        ("NOT no_empty", "SURFACE08_SYNTHETIC_OVERFIT_OR_REAL_REGRESSION"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 3", "SURFACE08_NEW_BEST_DIRECTIONAL_CANDIDATE"),
        ("synthetic_safe AND envelope_within_tolerance AND envelope_better >= 1", "SURFACE08_MATCHES_SURFACE07_WITH_ACCEPTABLE_TRADEOFF"),
        ("selected_round > 0 AND NOT envelope_fleurs_within", "SURFACE08_ARTUR_DEV_GOOD_BUT_FLEURS_REGRESSES"),
        ("synthetic_safe AND all_better", "SURFACE08_BEATS_BASE_BUT_NOT_SURFACE07"),
        ("true", "SURFACE08_SYNTHETIC_OVERFIT_OR_REAL_REGRESSION"),
    ],
}


def label(rule: str) -> Column:
    """The label of a rule as an expression over facts; null conditions don't hold."""
    return F.coalesce(*(F.when(F.expr(condition), F.lit(said)) for condition, said in RULES[rule]))


#: Reasons against a promotion, over facts and the columns integrity, synthetic_wer_gain and synthetic_cer_gain (relative, in percent).
PROMOTION = (
    ("NOT integrity", "state-dictionary integrity failed"),
    ("synthetic_wer_gain < 15 AND synthetic_cer_gain < 15", "synthetic holdout did not improve by 15% relative WER or CER"),
    ("wer_delta > 1.0", "real-gate corpus WER regressed by more than 1.0 absolute point"),
    ("cer_delta > 1.5", "real-gate corpus CER regressed by more than 1.5 absolute points"),
    ("empty_delta > 0", "real-gate empty-hypothesis count increased"),
)


def promotion_reasons() -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(c), F.lit(said)) for c, said in PROMOTION)))


def envelope(*challengers: DataFrame) -> DataFrame:
    """The best rates of several challengers, by split."""
    every = challengers[0]
    for c in challengers[1:]:
        every = every.unionByName(c)
    return every.groupBy("split").agg(F.min("wer").alias("wer"), F.min("cer").alias("cer"), F.min("empty").alias("empty"))


#: The earlier best rate of the divergence rule.
EARLIER_BEST = 43.443


def divergence_stop(curve: DataFrame, by: str) -> DataFrame:
    """by and the reason why a curve stops or goes on. curve: by, round (from 0, the base), wer, empty, anchor, scale (probe losses).

    Stops if the latest round has empties, if two rounds in turn are 5 points over the earlier best, or if both probes got
    better than at the base while the rate is 8 points over the curve's best; else the plain rule over the later rounds
    decides: empties, two rounds 5 points over the best, three rounds without a new best."""
    w = Window.partitionBy(by).orderBy("round")
    later = F.col("round") > 0
    before = F.min(F.when(later, F.col("wer"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = curve.withColumn("new", later & F.coalesce(F.col("wer") < before, F.lit(True))).withColumn("lag", F.lag("wer").over(w))
    last = F.max_by(F.struct("round", "wer", "empty", "anchor", "scale", "lag"), "round")
    base = F.max(F.when(~later, F.struct("anchor", "scale")))
    got = rows.groupBy(by).agg(
        last.alias("z"),
        base.alias("b"),
        F.min("wer").alias("least"),
        F.min(F.when(later, F.col("wer"))).alias("best"),
        F.max(F.when(F.col("new"), F.col("round"))).alias("at"),
        F.coalesce(F.bool_or((F.col("round") > 1) & (F.col("empty") > 0)), F.lit(False)).alias("empties"),
    )
    n, wer, lag = F.col("z.round"), F.col("z.wer"), F.col("z.lag")
    reason = (
        F.when(n < 1, "minimum_rounds_not_reached")
        .when((n > 1) & (F.col("z.empty") > 0), "surface08_empty_hypotheses_reappeared")
        .when((n >= 2) & (wer > EARLIER_BEST + 5.0) & (lag > EARLIER_BEST + 5.0), "surface08_two_consecutive_rounds_worse_than_surface07_by_5")
        .when((F.col("z.anchor") < F.col("b.anchor")) & (F.col("z.scale") < F.col("b.scale")) & (wer > F.col("least") + 8.0), "surface08_synthetic_real_divergence_over_8")
        .when(n < 3, "minimum_rounds_not_reached")
        .when(F.col("empties"), "empty_hypotheses_reappeared")
        .when((wer > F.col("best") + 5.0) & (lag > F.col("best") + 5.0), "two_consecutive_catastrophic_wer_regressions")
        .when(n - F.col("at") >= 3, "three_rounds_without_new_raw_best")
        .otherwise("new_best_patience_active")
    )
    return got.select(by, reason.alias("reason"))


def parity_eligible(most_memory: float) -> Column:
    return (F.col("status") == "PASSED") & F.col("exact_parity") & (F.coalesce("peak_memory_mib", F.lit(0.0)) <= most_memory)


def batch_policy(arms: DataFrame, fraction: float) -> DataFrame:
    """The smallest eligible batch within `fraction` of the best throughput; batch 1 if none is eligible."""
    good = arms.where("parity_eligible AND throughput IS NOT NULL")
    best = good.agg(F.max("throughput").alias("best"))
    chosen = good.crossJoin(F.broadcast(best)).where(F.col("throughput") >= F.col("best") * fraction).agg(F.min_by(F.struct("batch_size", "bucketed", "throughput", "best"), "batch_size").alias("c"))
    return chosen.select(F.coalesce("c.batch_size", F.lit(1)).alias("batch_size"), F.coalesce("c.bucketed", F.lit(True)).alias("bucketed"), "c.throughput", "c.best")


def first_passed(outcomes: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """The first candidate of `order` that passed, or no row."""
    place = F.array_position(F.array(*(F.lit(o) for o in order)), F.col("candidate"))
    return outcomes.where((F.col("outcome") == "PASSED") & (place > 0)).agg(F.min_by("candidate", place).alias("candidate")).where("candidate IS NOT NULL")


def review_status(codes: Column, hard: tuple[str, ...]) -> Column:
    return F.when(F.exists(codes, lambda c: c.isin(*hard)), "TEXT_REJECTED").otherwise("DRAFT")


def worst_status(severity: Column) -> Column:
    """FAILED over BLOCKED over NOT_RUN over REVIEW_REQUIRED over PASSED, of a group's severities."""
    ranks = F.create_map(*(x for s, r in (("failed", 4), ("blocked", 3), ("not_run", 2), ("review_required", 1)) for x in (F.lit(s), F.lit(r))))
    return F.element_at(F.array(*(F.lit(s) for s in ("PASSED", "REVIEW_REQUIRED", "NOT_RUN", "BLOCKED", "FAILED"))), F.coalesce(F.max(ranks[severity]), F.lit(0)) + 1)


def worth_larger_batch(larger: str, smaller: str, most_memory: float, gain: float) -> Column:
    """Whether to try a still larger batch: the larger of two (struct columns with status, parity_eligible, peak_memory_mib, throughput) passed, fits and is faster by `gain`."""
    a, b = F.col(larger), F.col(smaller)
    fits = (a["status"] == "PASSED") & a["parity_eligible"] & (F.coalesce(a["peak_memory_mib"], F.lit(0.0)) <= most_memory)
    return F.coalesce(fits & (b["throughput"] > 0) & (a["throughput"] >= b["throughput"] * gain), F.lit(False))
