"""Queries of the decision rules: rates by model and split through decisions.facts and its rules, and the smaller choices.

Models are suppliers, whose rates move off a base by steps of a quarter point, so that sums and thresholds are exact. The
DuckDB statements pivot the rates and spell each rule out by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, ranks, schedules
from ..sources.tables import table

SPLITS = ("fleurs_v2", "artur_j", "piper_synthetic_holdout", "supertonic_heldout_voice_holdout")
#: By split: base rates and empties, earlier rates and empties, and the steps' multipliers of the models.
BASE = {"fleurs_v2": (52.5, 16.5, 1), "artur_j": (67.25, 28.75, 12), "piper_synthetic_holdout": (60.0, 20.0, 0), "supertonic_heldout_voice_holdout": (58.0, 19.0, 0)}
PRIOR = {"fleurs_v2": (52.0, 16.25, 1), "artur_j": (66.5, 28.25, 10), "piper_synthetic_holdout": (59.0, 19.5, 0), "supertonic_heldout_voice_holdout": (57.5, 18.5, 0)}
STEPS = {"fleurs_v2": (7, 5), "artur_j": (3, 11), "piper_synthetic_holdout": (13, 2), "supertonic_heldout_voice_holdout": (5, 9)}
COMPARATORS = ("scale200", "scale2000", "pr36", "clean", "surface07", "envelope")


def _rates(spark, sf_dir):
    """model, split, wer, cer, empty"""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"))
    rows = []
    for split in SPLITS:
        (w, c, e), (a, b) = BASE[split], STEPS[split]
        good = F.col("model") % 3 == 0  # every third model is better nearly everywhere
        wer = w + F.when(good, -(F.col("model") * a % 12)).otherwise(F.col("model") * a % 19 - 12) / 4
        cer = c + F.when(good, -(F.col("model") * b % 9)).otherwise(F.col("model") * b % 17 - 11) / 4
        empty = F.when(F.col("model") % 4 == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), e + F.col("model") % 3 - 1))
        rows.append(s.select("model", F.lit(split).alias("split"), wer.cast("double").alias("wer"), cer.cast("double").alias("cer"), empty.cast("int").alias("empty")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def _fixed(spark, rates):
    return spark.createDataFrame([(s, *rates[s]) for s in SPLITS], "split string, wer double, cer double, empty int")


def _facts(spark, sf_dir):
    prior = _fixed(spark, PRIOR)
    found = decisions.facts(_rates(spark, sf_dir), _fixed(spark, BASE), **dict.fromkeys(COMPARATORS, prior))
    n = F.col("model")
    return found.withColumns({
        "integrity": n % 11 != 0, "selected_round": n % 4, "max_round": F.lit(3), "bridge_proven": n % 13 != 0, "improves_prior": F.col("envelope_better") > 0,
        "s6_gain": F.col("piper_gain") & F.col("supertonic_gain"), "s6_beats_pr36": F.when(n % 5 != 0, F.col("pr36_better") >= 2), "holdout_gain": F.col("synthetic_gain"), "clean_burden": F.lit(2.5),
        "text_validation_improved": n % 2 == 0, "synthetic_relative_gain": (n % 40).cast("double"), "prior_count": n % 3, "best_count": F.col("surface07_better"), "within_best": F.col("surface07_within_tolerance"),
        "prior_stronger": n % 7 == 0, "real_gain": F.col("non_regression") & F.col("improvement"), "synthetic_gain_10": n % 6 == 0,
        "reference_speed": F.lit(10.0), "batched_speed": (n % 20).cast("double"), "equivalent": n % 2 == 1, "selected_batch": n % 3, "exact_parity": n % 5 != 0, "speedup": 1 + (n % 3) / 8,
        "replay_safe": F.col("none_worse"), "replay_improvement": F.col("improvement"), "replay_gain": F.col("synthetic_gain"), "canonical_gain": n % 2 == 0, "canonical_safe": F.lit(False), "replay_reduction": (n % 50).cast("double"), "canonical_reduction": (n % 45).cast("double"),
    })


def rule_labels(spark, sf_dir):
    """The label of every rule for every model."""
    found = _facts(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(rule).alias("rule"), decisions.label(rule).alias("label")) for rule in decisions.RULES))
    return found.select("model", F.inline(cells))


def rule_facts(spark, sf_dir):
    names = ("burden", "non_regression", "improvement", "any_better", "all_better", "none_worse", "catastrophic", "piper_gain", "supertonic_gain", "synthetic_safe", "pr36_better", "pr36_within_tolerance", "pr36_within_loose")
    return _facts(spark, sf_dir).select("model", *names)


def promotion_verdicts(spark, sf_dir):
    """Reasons against each model; promoted if there are none."""
    n = F.col("model")
    facts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"))
    facts = facts.withColumns({"integrity": n % 11 != 0, "synthetic_wer_gain": (n * 7 % 30).cast("double"), "synthetic_cer_gain": (n * 5 % 30).cast("double"), "wer_delta": (n % 9 - 5) / 2, "cer_delta": (n % 7 - 3) / 2, "empty_delta": n % 5 - 3})
    reasons = decisions.promotion_reasons()
    return facts.select("model", F.size(reasons).cast("long").alias("reasons"), (F.size(reasons) == 0).alias("promoted"), F.array_contains(reasons, decisions.PROMOTION[2][1]).alias("wer_regressed"))


# the statement: rates side by side, d* against the base, q* against the earlier rates
def _pivot() -> str:
    cols = []
    for split, k in zip(SPLITS, "faps", strict=True):
        (w, c, e), (pw, pc, pe), (a, b) = BASE[split], PRIOR[split], STEPS[split]
        wer = f"(CASE WHEN n % 3 = 0 THEN -(n * {a} % 12) ELSE n * {a} % 19 - 12 END) / 4"
        cer = f"(CASE WHEN n % 3 = 0 THEN -(n * {b} % 9) ELSE n * {b} % 17 - 11 END) / 4"
        empty = f"CASE WHEN n % 4 = 1 THEN 0 ELSE greatest(0, {e} + n % 3 - 1) END"
        cols += [f"{wer} AS d{k}w", f"{cer} AS d{k}c", f"{wer} + {w - pw} AS q{k}w", f"{cer} + {c - pc} AS q{k}c", f"{empty} AS e{k}", f"{e} AS be{k}", f"{pe} AS qe{k}"]
    return f"m AS (SELECT s_suppkey AS n, {', '.join(cols)} FROM supplier)"


def _all(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def _each(prefix: str, splits: str, most: str, other: str | None = None, sign: str = "<=") -> str:
    return _all(*(f"{prefix}{k}w {sign} {most} AND {prefix}{k}c {sign} {other or most}" for k in splits))


_ANY = lambda prefix, splits: "(" + " OR ".join(f"{prefix}{k}w < 0 OR {prefix}{k}c < 0" for k in splits) + ")"
_FACTS = f"""WITH {_pivot()}, b AS (SELECT *, greatest(0.0, dfw) + greatest(0.0, dfc) + greatest(0.0, daw) + greatest(0.0, dac) AS burden, ef <= bef AND ea <= bea AS empty_ok, ef = 0 AND ea = 0 AS no_empty,
  {_ANY('d', 'p')} AS piper_gain, {_ANY('d', 's')} AS supertonic_gain, {_ANY('d', 'ps')} AS synthetic_gain, {_each('d', 'ps', '0', sign='<')} AS synthetic_safe,
  {_each('d', 'fa', '1.0', '1.5')} AND ef <= bef AND ea <= bea AS non_regression, (dfw <= -1.0 OR daw <= -1.0 OR dfc <= -1.5 OR dac <= -1.5) AS improvement,
  {_ANY('d', 'fa')} AS any_better, {_each('d', 'fa', '0', sign='<')} AS all_better, {_each('d', 'fa', '0')} AS none_worse, {_each('d', 'fa', '0.25')} AS within_quarter, NOT ({_each('d', 'fa', '1.0')} AND ef <= bef AND ea <= bea) AS catastrophic,
  (qfw < 0)::INT + (qfc < 0)::INT + (qaw < 0)::INT + (qac < 0)::INT AS better, {_each('q', 'fa', '0', sign='<')} AS prior_all, {_each('q', 'fa', '0.50', '0.25')} AS tolerated, {_each('q', 'fa', '0.75', '0.35')} AS loose, {_each('q', 'fa', '0.5')} AS none_half, {_each('q', 'fa', '1.0')} AS none_one, {_each('q', 'ps', '1.0')} AS synthetic_one,
  abs(qfw) <= 0.5 AND abs(qfc) <= 0.5 AND abs(qaw) <= 0.5 AND abs(qac) <= 0.5 AS half, abs(qpw) <= 1 AND abs(qpc) <= 1 AND abs(qsw) <= 1 AND abs(qsc) <= 1 AS synthetic_half, ef <= qef AND ea <= qea AS prior_empty_ok, qfw <= 0.5 AND qfc <= 0.25 AS fleurs_within, qaw < 0 OR qac < 0 AS artur_better FROM m)"""
RULE_FACTS = f"{_FACTS} SELECT n AS model, burden, non_regression, improvement, any_better, all_better, none_worse, catastrophic, piper_gain, supertonic_gain, synthetic_safe, better::BIGINT AS pr36_better, tolerated AS pr36_within_tolerance, loose AS pr36_within_loose FROM b"


def _case(rule: str, *cases: tuple[str, str], otherwise: str) -> str:
    return f"SELECT n AS model, '{rule}' AS rule, CASE " + " ".join(f"WHEN {c} THEN '{said}'" for c, said in cases) + f" ELSE '{otherwise}' END AS label FROM b"


def _prior_case(rule: str, name: str, beats: str, matches: str, only: str, under: str) -> str:
    gains = "piper_gain AND supertonic_gain AND burden = 0"
    return _case(rule, (f"{gains} AND better >= 2 AND none_half AND synthetic_one", f"{name}_{beats}"), (f"{gains} AND half AND synthetic_half", f"{name}_{matches}"), (gains, f"{name}_{only}"), otherwise=f"{name}_{under}")


_INVALID = ("n % 11 = 0", "EXPERIMENT_INVALID")
_NEW = "synthetic_safe AND tolerated AND better >= 3"
RULE_LABELS = f"{_FACTS} " + " UNION ALL ".join((
    _case("scale2000", ("piper_gain AND supertonic_gain AND non_regression AND improvement", "SCALE2000_TEXT_REAL_GAIN_DIRECTIONAL"), ("piper_gain AND supertonic_gain AND burden <= 2.0076 AND burden <= 2.0076 AND none_half", "SCALE2000_TEXT_IMPROVES_SCALE200"), ("piper_gain AND supertonic_gain AND burden >= 2.0076 AND burden <= 3.7284 AND NOT non_regression", "SCALE2000_TEXT_PLATEAUS"), ("NOT (piper_gain AND supertonic_gain) OR burden > 3.7284 OR NOT none_one AND NOT improvement", "SCALE2000_TEXT_DEGRADES"), otherwise="EXPERIMENT_INVALID"),
    _prior_case("scale8000_clean", "SCALE8000_CLEAN", "BEATS_SCALE2000_AUGMENTED_DIRECTIONAL", "MATCHES_SCALE2000_AUGMENTED_DIRECTIONAL", "BEATS_BASE_BUT_NOT_SCALE2000", "UNDERPERFORMS_DIRECTIONALLY"),
    _prior_case("decoder_joint", "DECODER_JOINT_RNNT", "BEATS_SCALE2000_DIRECTIONAL", "MATCHES_SCALE2000_DIRECTIONAL", "BEATS_BASE_BUT_NOT_SCALE2000", "SYNTHETIC_ONLY_OR_REGRESSES"),
    _case("hardvoice", ("piper_gain AND supertonic_gain AND none_worse AND loose AND prior_empty_ok AND (n % 5 = 0 OR better >= 2)", "S6TTS_HARDVOICE_IMPACT_POSITIVE_REAL_SAFE"), ("piper_gain AND supertonic_gain AND none_worse", "S6TTS_HARDVOICE_IMPROVES_S6_SYNTHETIC_ONLY"), ("NOT none_worse OR NOT empty_ok", "S6TTS_HARDVOICE_REAL_REGRESSION"), otherwise="S6TTS_HARDVOICE_NO_S6_GAIN"),
    _case("artur_earlystop", ("n % 4 = 0", "ARTUR_EARLYSTOP_NO_REAL_DEV_GAIN"), ("n % 4 = 3", "ARTUR_EARLYSTOP_SELECTS_ROUND20_OR_MAXROUND"), ("burden = 0 AND loose", "ARTUR_EARLYSTOP_FINDS_EFFICIENT_EARLIER_CHECKPOINT"), otherwise="ARTUR_EARLYSTOP_SELECTED_CHECKPOINT_DIRECTIONAL_REGRESSES"),
    _case("speaker_range", ("synthetic_gain AND non_regression", "SPEAKER_RANGE_AUGMENTATION_PREVENTS_REAL_REGRESSION"), ("synthetic_gain AND (2.5 - burden) / 2.5 * 100 >= 30 AND none_half", "SPEAKER_RANGE_AUGMENTATION_MITIGATES_REAL_REGRESSION"), otherwise="SPEAKER_RANGE_AUGMENTATION_NOT_SUPPORTED"),
    _case("text_only", ("burden = 0 AND any_better AND within_quarter AND empty_ok", "TEXT_ONLY_DECODER_LM_REAL_GAIN_DIRECTIONAL"), ("catastrophic", "TEXT_ONLY_DECODER_LM_DEGRADES_ASR"), ("synthetic_gain AND burden > 0", "TEXT_ONLY_DECODER_LM_HELPS_SYNTHETIC_ONLY"), ("n % 2 = 0", "TEXT_ONLY_DECODER_LM_NO_ASR_GAIN"), otherwise="TEXT_ONLY_DECODER_LM_DEGRADES_ASR"),
    _case("scientific", ("non_regression AND improvement", "CORPUS_V2_PROMPT_COLUMN_REAL_GAIN_DIAGNOSTIC"), ("n % 6 = 0", "CORPUS_V2_PROMPT_COLUMN_SYNTHETIC_ONLY"), otherwise="CORPUS_V2_PROMPT_COLUMN_NOT_SUPPORTED"),
    _case("batching", _INVALID, ("n % 20 >= 12.5 AND n % 2 = 1", "A100_PROMPT_TRAINING_BATCH_SUPPORTED"), otherwise="A100_PROMPT_TRAINING_BATCH_NOT_EQUIVALENT"),
    _case("streaming_batches", ("n % 3 = 2 AND n % 5 <> 0", "A100_BATCHED_STREAMING_SUPPORTED"), ("n % 5 <> 0", "A100_BATCHED_STREAMING_EQUIVALENT_NO_MATERIAL_GAIN"), otherwise="A100_BATCHED_STREAMING_NOT_EQUIVALENT"),
    _case("canonical", ("NOT all_better OR NOT empty_ok", "CANONICAL_REJECTS_SURFACE07_DIRECTIONAL_GAIN"), ("n % 3 = 0 OR better >= 3 AND tolerated", "CANONICAL_SURFACE07_CONFIRMED_NEW_BEST"), ("n % 7 = 0", "CANONICAL_SURFACE06_OR_PRIOR_STRONGER"), otherwise="CANONICAL_SURFACE07_CONFIRMED_BUT_MIXED"),
    _case("directional", ("none_worse AND improvement AND synthetic_gain", "FAST_DIRECTIONAL_REPLAY_CHANGES_CONCLUSION_POSITIVELY"), ("NOT synthetic_gain OR n % 50 < 20", "FAST_DIRECTIONAL_REPLAY_CHANGES_CONCLUSION_NEGATIVELY"), ("n % 2 = 0 AND n % 45 >= 20 AND NOT none_worse", "FAST_DIRECTIONAL_REPLAY_CONFIRMS_CONCLUSION"), otherwise="FAST_DIRECTIONAL_REPLAY_INCONCLUSIVE"),
    _case("round1", _INVALID, ("NOT non_regression OR n % 40 < 15", "ROUND1_REJECTED"), ("improvement", "ROUND1_ACCEPTED_REAL_GENERALIZATION"), otherwise="ROUND1_SYNTHETIC_ONLY"),
    _case("surface04", _INVALID, ("NOT no_empty", "SURFACE04_SYNTHETIC_OR_REAL_REGRESSION"), ("prior_all AND synthetic_safe", "SURFACE04_BEATS_PR36_DIRECTIONAL"), ("tolerated AND better > 0 AND synthetic_safe", "SURFACE04_MATCHES_PR36_WITH_ACCEPTABLE_TRADEOFF"), ("all_better", "SURFACE04_BEATS_BASE_BUT_NOT_PR36"), ("n % 4 > 0", "SURFACE04_ARTUR_DEV_GOOD_BUT_GATE_DIRECTIONAL_REGRESSES"), otherwise="SURFACE04_SYNTHETIC_OR_REAL_REGRESSION"),
    _case("surface05", _INVALID, ("NOT no_empty", "SURFACE05_SYNTHETIC_OR_REAL_REGRESSION"), (_NEW, "SURFACE05_NEW_BEST_DIRECTIONAL_CANDIDATE"), ("synthetic_safe AND tolerated AND better > 0", "SURFACE05_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"), ("synthetic_safe AND all_better", "SURFACE05_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"), ("n % 4 > 0", "SURFACE05_ARTUR_DEV_GOOD_BUT_GATE_DIRECTIONAL_REGRESSES"), otherwise="SURFACE05_SYNTHETIC_OR_REAL_REGRESSION"),
    _case("surface06", _INVALID, ("NOT no_empty", "SURFACE06_SYNTHETIC_OR_REAL_REGRESSION"), (_NEW, "SURFACE06_NEW_BEST_DIRECTIONAL_CANDIDATE"), ("synthetic_safe AND tolerated AND better > 0", "SURFACE06_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"), ("n % 4 > 0 AND artur_better AND NOT fleurs_within", "SURFACE06_ARTUR_DEV_GOOD_BUT_FLEURS_REGRESSES"), ("synthetic_safe AND all_better", "SURFACE06_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"), otherwise="SURFACE06_SYNTHETIC_OR_REAL_REGRESSION"),
    _case("surface07", ("n % 13 = 0", "BLOCKED_FUSION_BRIDGE_UNRESOLVED"), _INVALID, ("NOT no_empty", "SURFACE07_SYNTHETIC_OR_REAL_REGRESSION"), (_NEW, "SURFACE07_NEW_BEST_DIRECTIONAL_CANDIDATE"), ("synthetic_safe AND tolerated AND better >= 1", "SURFACE07_MATCHES_BEST_WITH_ACCEPTABLE_TRADEOFF"), ("n % 4 > 0 AND artur_better AND NOT fleurs_within", "SURFACE07_FUSION_GOOD_BUT_FLEURS_REGRESSES"), ("synthetic_safe AND all_better", "SURFACE07_BEATS_BASE_BUT_NOT_PRIOR_CHALLENGERS"), otherwise="SURFACE07_SYNTHETIC_OR_REAL_REGRESSION"),
    _case("surface08", _INVALID, ("NOT no_empty", "SURFACE08_SYNTHETIC_OVERFIT_OR_REAL_REGRESSION"), (_NEW, "SURFACE08_NEW_BEST_DIRECTIONAL_CANDIDATE"), ("synthetic_safe AND tolerated AND better >= 1", "SURFACE08_MATCHES_SURFACE07_WITH_ACCEPTABLE_TRADEOFF"), ("n % 4 > 0 AND NOT fleurs_within", "SURFACE08_ARTUR_DEV_GOOD_BUT_FLEURS_REGRESSES"), ("synthetic_safe AND all_better", "SURFACE08_BEATS_BASE_BUT_NOT_SURFACE07"), otherwise="SURFACE08_SYNTHETIC_OVERFIT_OR_REAL_REGRESSION"),
))
PROMOTION_VERDICTS = """WITH m AS (SELECT s_suppkey AS n FROM supplier), r AS (SELECT n, (n % 11 = 0)::INT AS a, (n * 7 % 30 < 15 AND n * 5 % 30 < 15)::INT AS b, ((n % 9 - 5) / 2 > 1)::INT AS c, ((n % 7 - 3) / 2 > 1.5)::INT AS d, (n % 5 > 3)::INT AS e FROM m)
SELECT n AS model, (a + b + c + d + e)::BIGINT AS reasons, a + b + c + d + e = 0 AS promoted, c = 1 AS wer_regressed FROM r"""


def arm_choices(spark, sf_dir):
    """Per nation: the batch that its suppliers' arms choose, whether a larger one is worth trying, and the first candidate that passed."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    arms = s.select("s_nationkey", (n % 4 + 1).cast("int").alias("batch_size"), (n % 2 == 0).alias("bucketed"), F.when(n % 6 == 0, "OOM").otherwise("PASSED").alias("status"), (n % 7 != 0).alias("exact_parity"), (n % 50).cast("double").alias("peak_memory_mib"), (n % 23 + 1).cast("double").alias("throughput"))
    arms = arms.withColumn("parity_eligible", decisions.parity_eligible(40.0))
    policy = decisions.batch_policy(arms, 0.9).select(F.lit("policy").alias("choice"), F.col("batch_size").cast("long").alias("value"))
    passed = decisions.first_passed(arms.select(F.col("batch_size").alias("candidate"), F.when((F.col("batch_size") < 4) & (F.col("status") == "PASSED"), "PASSED").otherwise("FAILED").alias("outcome")), (4, 2, 1))
    passed = passed.select(F.lit("first_passed").alias("choice"), F.col("candidate").cast("long").alias("value"))
    arm = F.struct("status", "parity_eligible", "peak_memory_mib", "throughput")
    both = arms.groupBy("s_nationkey").agg(F.max_by(arm, F.struct("batch_size", "throughput", "peak_memory_mib")).alias("a"), F.min_by(arm, F.struct("batch_size", "throughput", "peak_memory_mib")).alias("b"))
    worth = both.where(decisions.worth_larger_batch("a", "b", 40.0, 1.1)).select(F.lit("worth_larger").alias("choice"), F.col("s_nationkey").cast("long").alias("value"))
    return policy.unionAll(passed).unionAll(worth)


ARM_CHOICES = """WITH a AS (SELECT s_nationkey AS k, s_suppkey % 4 + 1 AS b, CASE WHEN s_suppkey % 6 = 0 THEN 'OOM' ELSE 'PASSED' END AS st, s_suppkey % 7 <> 0 AS par, (s_suppkey % 50)::DOUBLE AS mem, (s_suppkey % 23 + 1)::DOUBLE AS speed FROM supplier),
e AS (SELECT *, st = 'PASSED' AND par AND mem <= 40 AS ok FROM a), g AS (SELECT b FROM e WHERE ok AND speed >= 0.9 * (SELECT max(speed) FROM e WHERE ok)),
w AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY b, speed, mem) AS up, row_number() OVER (PARTITION BY k ORDER BY b DESC, speed DESC, mem DESC) AS down, st, ok, mem, speed FROM e),
j AS (SELECT x.k FROM w x JOIN w y ON x.k = y.k AND x.down = 1 AND y.up = 1 WHERE x.st = 'PASSED' AND x.ok AND x.mem <= 40 AND y.speed > 0 AND x.speed >= y.speed * 1.1)
SELECT 'policy' AS choice, coalesce(min(b), 1)::BIGINT AS value FROM g UNION ALL SELECT 'first_passed', b FROM (SELECT b FROM e WHERE b < 4 AND st = 'PASSED' AND b IN (1, 2) ORDER BY CASE b WHEN 2 THEN 0 ELSE 1 END LIMIT 1) UNION ALL SELECT 'worth_larger', k FROM j"""


def divergence_stops(spark, sf_dir):
    """The stop reason of each user's curve by the rule that also watches synthetic probes."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    placed = e.select("user_id", (F.row_number().over(_by_day()) - 1).alias("round"), F.round(F.col("v") / 4, 3).alias("wer"), F.when(F.col("n") > 9, 1).otherwise(0).alias("empty"), F.round(100 - F.col("n") * 5.0, 3).alias("anchor"), F.round(F.col("v"), 3).alias("scale"))
    return decisions.divergence_stop(placed, "user_id")


def _by_day():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("day")


DIVERGENCE_STOPS = """WITH e AS (SELECT user_id, ts::DATE AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS round, round(v / 4, 3) AS wer, CASE WHEN n > 9 THEN 1 ELSE 0 END AS empty, round(100 - n * 5.0, 3) AS anchor, round(v, 3) AS scale FROM e),
l AS (SELECT user_id, max(round) AS last, min(wer) AS best, arg_max(wer, round) AS wer, arg_max(empty, round) AS empty, arg_max(anchor, round) AS anchor, arg_max(scale, round) AS scale, min(anchor) FILTER (round = 0) AS anchor0, min(scale) FILTER (round = 0) AS scale0 FROM c GROUP BY 1),
t AS (SELECT user_id, min(wer) FILTER (round = last_) AS w1, min(wer) FILTER (round = last_ - 1) AS w2 FROM (SELECT *, max(round) OVER (PARTITION BY user_id) AS last_ FROM c) WHERE round > 0 GROUP BY 1),
p AS (SELECT user_id, min(wer) AS best, arg_min(round, (wer, round)) AS best_round, max(CASE WHEN round > 1 THEN empty ELSE 0 END) AS empties FROM c WHERE round > 0 GROUP BY 1)
SELECT l.user_id, CASE WHEN last < 1 THEN 'minimum_rounds_not_reached' WHEN last > 1 AND empty > 0 THEN 'surface08_empty_hypotheses_reappeared' WHEN last >= 2 AND w1 > 48.443 AND w2 > 48.443 THEN 'surface08_two_consecutive_rounds_worse_than_surface07_by_5'
WHEN anchor < anchor0 AND scale < scale0 AND l.wer > l.best + 8 THEN 'surface08_synthetic_real_divergence_over_8' WHEN last < 3 THEN 'minimum_rounds_not_reached' WHEN empties > 0 THEN 'empty_hypotheses_reappeared' WHEN w1 > p.best + 5 AND w2 > p.best + 5 THEN 'two_consecutive_catastrophic_wer_regressions'
WHEN last - best_round >= 3 THEN 'three_rounds_without_new_raw_best' ELSE 'new_best_patience_active' END AS reason FROM l LEFT JOIN p USING (user_id) LEFT JOIN t USING (user_id)"""


def exceeded_limits(spark, sf_dir):
    """Budgets that the attempts (orders by priority and clerk group) have used up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), (F.col("o_custkey") % 6).alias("shard"), F.lit(40).alias("requested"))
    return schedules.exhausted(o, {"total_attempts": 1000, "requested_rows": 10**9, "cell": 280, "shard": 260})


EXCEEDED_LIMITS = """WITH o AS (SELECT o_orderpriority AS cell, o_custkey % 6 AS shard FROM orders)
SELECT 'total_attempts' AS exceeded FROM o HAVING count(*) >= 1000 UNION ALL SELECT 'requested_rows' FROM o HAVING count(*) * 40 >= 1000000000 UNION ALL SELECT 'cell:' || cell FROM o GROUP BY cell HAVING count(*) >= 280 UNION ALL SELECT 'shard:' || shard FROM o GROUP BY shard HAVING count(*) >= 260"""

# ---- layouts through the schedules


def voice_groups(spark, sf_dir):
    """Twelve epochs in which groups of twenty records take the voices in turn."""
    return schedules.group_rotation(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [f"v{i}" for i in range(8)], 12)


_ORDER = "row_number() OVER (ORDER BY sha256({k}::VARCHAR), {k}) - 1"
VOICE_GROUPS = f"WITH p AS (SELECT p_partkey, {_ORDER.format(k='p_partkey')} AS pos FROM part) SELECT e::INT AS epoch, p_partkey, 'v' || ((pos // 20 + e - 1) % 8) AS voice FROM p, generate_series(1, 12) g(e)"


def latin_rotation(spark, sf_dir):
    return schedules.rotation(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", ["a", "b", "c", "d", "e"], 5)


LATIN_ROTATION = f"WITH p AS (SELECT c_custkey, {_ORDER.format(k='c_custkey')} AS pos FROM customer) SELECT e::INT AS epoch, c_custkey, ((pos + e - 1) % 5)::INT AS profile_index, ['a', 'b', 'c', 'd', 'e'][(pos + e - 1) % 5 + 1] AS profile_id FROM p, generate_series(1, 5) g(e)"


def rotation_balance(spark, sf_dir):
    """Rows by epoch and profile, their spread, and how many records miss a profile."""
    laid = latin_rotation(spark, sf_dir)
    missed = laid.groupBy("c_custkey").agg(F.count_distinct("profile_id").alias("n")).where("n <> 5").agg(F.count(F.lit(1)).alias("missed"))
    return schedules.balance(laid, "epoch", "profile_id").crossJoin(F.broadcast(missed))  # one row on the right


ROTATION_BALANCE = f"WITH r AS ({LATIN_ROTATION}), b AS (SELECT epoch, profile_id, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT c_custkey FROM r GROUP BY 1 HAVING count(DISTINCT profile_id) <> 5) SELECT b.*, (SELECT max(n) - min(n) FROM b) AS spread, (SELECT count(*) FROM k) AS missed FROM b"


def clean_rounds(spark, sf_dir):
    """A clean round per voice, and rows by round and voice."""
    laid = schedules.exposures(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", [f"v{i}" for i in range(9)], [])
    return laid.select("round", "semantic_position", "semantic_key", "voice", "spec_augment", "batch_order_seed")


CLEAN_ROUNDS = f"WITH p AS (SELECT s_suppkey, {_ORDER.format(k='s_suppkey')} AS pos FROM supplier) SELECT (r + 1)::INT AS round, pos AS semantic_position, s_suppkey AS semantic_key, 'v' || r AS voice, false AS spec_augment, sha256('1234:' || (r + 1) || ':' || pos) AS batch_order_seed FROM p, generate_series(0, 8) g(r)"


def drawn_parameters(spark, sf_dir):
    key = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part")
    tempo = schedules.parameters("tempo_preserving_pitch", {"minimum_factor": 0.5, "maximum_factor": 1.5}, key)
    codec = schedules.parameters("codec_sample_rate_simulation", {"codecs": ["mp3", "ogg", "gsm"]}, key)
    return p.select("p_partkey", tempo["tempo_factor"].cast("double").alias("tempo"), codec["codec"].alias("codec"))


_HEX = lambda x, n: f"('0x' || substr(sha256({x}), 1, {n}))::BIGINT"
DRAWN_PARAMETERS = f"SELECT p_partkey, round(0.5 + {_HEX(chr(39) + 'part-' + chr(39) + ' || p_partkey || ' + chr(39) + ':tempo_preserving_pitch' + chr(39), 12)} / 281474976710655.0, 6) AS tempo, ['mp3', 'ogg', 'gsm'][{_HEX(chr(39) + 'part-' + chr(39) + ' || p_partkey || ' + chr(39) + ':codec_sample_rate_simulation' + chr(39), 8)} % 3 + 1] AS codec FROM part"


def rate_controls(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 8).alias("rate"))
    return schedules.controls_by_rate(d, "p_partkey", "rate", 3, 25)


RATE_CONTROLS = "SELECT p_partkey, p_size / 8 AS rate FROM part ORDER BY sha256('3:' || p_partkey || ':' || round(p_size / 8, 3)::VARCHAR), p_partkey LIMIT 25"


def stable_ranks(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranks.global_rank(d, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "pos")


STABLE_RANKS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders"


def padded_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 16).alias("duration"))
    out = schedules.padding(schedules.batches(d, 32, F.col("duration"), F.col("doc_id")), "duration", 32)
    return out.select("batches", F.round("padded", 3).alias("padded"), F.round("actual", 3).alias("actual"), F.round("ratio", 4).alias("ratio"), "final_partial")


PADDED_BATCHES = """WITH p AS (SELECT n_chars / 16 AS d, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS b FROM documents), g AS (SELECT count(*) AS n, max(d) AS m, sum(d) AS t FROM p GROUP BY b)
SELECT count(*) AS batches, round(sum(m * n), 3) AS padded, round(sum(t), 3) AS actual, round(sum(m * n) / sum(t), 4) AS ratio, coalesce(min(n) FILTER (n < 32), 0) AS final_partial FROM g"""

QUERIES = {
    "rule_facts": (rule_facts, RULE_FACTS),
    "rule_labels": (rule_labels, RULE_LABELS),
    "promotion_verdicts": (promotion_verdicts, PROMOTION_VERDICTS),
    "arm_choices": (arm_choices, ARM_CHOICES),
    "divergence_stops": (divergence_stops, DIVERGENCE_STOPS),
    "exceeded_limits": (exceeded_limits, EXCEEDED_LIMITS),
    "voice_groups": (voice_groups, VOICE_GROUPS),
    "latin_rotation": (latin_rotation, LATIN_ROTATION),
    "rotation_balance": (rotation_balance, ROTATION_BALANCE),
    "clean_rounds": (clean_rounds, CLEAN_ROUNDS),
    "drawn_parameters": (drawn_parameters, DRAWN_PARAMETERS),
    "rate_controls": (rate_controls, RATE_CONTROLS),
    "stable_ranks": (stable_ranks, STABLE_RANKS),
    "padded_batches": (padded_batches, PADDED_BATCHES),
}
