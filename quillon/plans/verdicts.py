"""Verdicts whose votes, gains and equivalences are computed from rates: the models of plans.rulings against two earlier ones.

Experiments are forty groups of models, their arms; every fifth model is no valid arm. Statements spell the sums out by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from .rulings import _FACTS, BASE, PRIOR, SPLITS, _fixed, _rates

#: The other earlier model is better than the base by half a point and a quarter.
NEAR = {s: (w - 0.5, c - 0.25, e) for s, (w, c, e) in BASE.items()}
TOLERANCES = {"piper_synthetic_holdout": 1.0, "fleurs_v2": 0.5, "artur_j": 0.5}


def _rivals(spark):
    return _fixed(spark, PRIOR).withColumn("model", F.lit("prior")).unionByName(_fixed(spark, NEAR).withColumn("model", F.lit("near")))


def canonical_verdicts(spark, sf_dir):
    """Votes against both earlier models, and the label they lead to."""
    rates, base = _rates(spark, sf_dir), _fixed(spark, BASE)
    found = decisions.facts(rates, base).join(decisions.votes(rates, _rivals(spark)), "model")
    return found.select("model", "prior_count", "best_count", "within_best", "prior_stronger", decisions.label("canonical").alias("label"))


def holdout_gains(spark, sf_dir):
    """Relative gains on the synthetic holdout, and whether a model is as good as the earlier one within tolerances."""
    rates = _rates(spark, sf_dir)
    gains = decisions.relative_gains(rates, _fixed(spark, BASE), "piper_synthetic_holdout")
    return gains.join(decisions.equivalence(rates, _fixed(spark, PRIOR), TOLERANCES), "model")


def experiment_verdicts(spark, sf_dir):
    """What the valid arms of each experiment show together."""
    rates, base = _rates(spark, sf_dir), _fixed(spark, BASE)
    facts = decisions.facts(rates, base).withColumn("experiment", F.col("model") % 40)
    return decisions.arms(facts, decisions.relative_gains(rates, base, "piper_synthetic_holdout"), "experiment", F.col("model") % 5 != 0)


_LONG = " UNION ALL ".join(f"SELECT n, '{s}' AS split, '{m}' AS metric, {tol} AS tol, {BASE[s][i]} + d{k}{m[0]} AS v FROM b" for s, k in zip(SPLITS[:2], "fa", strict=True) for i, (m, tol) in enumerate((("wer", 0.5), ("cer", 0.25))))
_KNOWN = ", ".join(f"('{name}', '{s}', '{m}', {rates[s][i]})" for name, rates in (("prior", PRIOR), ("near", NEAR)) for s in SPLITS[:2] for i, m in enumerate(("wer", "cer")))
_GAIN = "g AS (SELECT n, (0.0 - dpw) / 60.0 * 100 AS gw, (0.0 - dpc) / 20.0 * 100 AS gc FROM b)"
SQL = {
    "canonical_verdicts": f"""{_FACTS}, l AS ({_LONG}), k AS (SELECT * FROM (VALUES {_KNOWN}) x(rival, split, metric, p)),
v AS (SELECT n, count(*) FILTER (v < p0) AS best_count, bool_and(v <= p0 + tol) AS within_best FROM l JOIN (SELECT split, metric, min(p) AS p0 FROM k GROUP BY ALL) USING (split, metric) GROUP BY n),
s AS (SELECT n, rival, count(*) FILTER (p < v) AS wins FROM l JOIN k USING (split, metric) GROUP BY n, rival), w AS (SELECT n, count(*) AS prior_count, max(wins) >= 3 AS prior_stronger FROM s GROUP BY n)
SELECT b.n AS model, prior_count, best_count, within_best, prior_stronger, CASE WHEN NOT (all_better AND empty_ok) THEN 'CANONICAL_REJECTS_SURFACE07_DIRECTIONAL_GAIN' WHEN best_count >= 3 AND within_best THEN 'CANONICAL_SURFACE07_CONFIRMED_NEW_BEST'
  WHEN prior_stronger THEN 'CANONICAL_SURFACE06_OR_PRIOR_STRONGER' ELSE 'CANONICAL_SURFACE07_CONFIRMED_BUT_MIXED' END AS label FROM b JOIN v USING (n) JOIN w USING (n)""",
    "holdout_gains": f"{_FACTS}, {_GAIN} SELECT n AS model, round(gw, 6) AS wer_relative_gain, round(gc, 6) AS cer_relative_gain, gw >= 10 OR gc >= 10 AS passes, abs(qpw) <= 1 AND abs(qpc) <= 1 AND abs(qfw) <= 0.5 AND abs(qfc) <= 0.5 AND abs(qaw) <= 0.5 AND abs(qac) <= 0.5 AND ef = qef AND ea = qea AS equivalent FROM b JOIN g USING (n)",
    "experiment_verdicts": f"""{_FACTS}, {_GAIN}, e AS (SELECT n % 40 AS experiment, coalesce(bool_or(non_regression AND improvement) FILTER (n % 5 <> 0), false) AS real_gain, coalesce(bool_or(gw >= 10 OR gc >= 10) FILTER (n % 5 <> 0), false) AS synthetic_gain FROM b JOIN g USING (n) GROUP BY 1)
SELECT *, CASE WHEN real_gain THEN 'CORPUS_V2_PROMPT_COLUMN_REAL_GAIN_DIAGNOSTIC' WHEN synthetic_gain THEN 'CORPUS_V2_PROMPT_COLUMN_SYNTHETIC_ONLY' ELSE 'CORPUS_V2_PROMPT_COLUMN_NOT_SUPPORTED' END AS label FROM e""",
}
QUERIES = {f.__name__: (f, SQL[f.__name__]) for f in (canonical_verdicts, holdout_gains, experiment_verdicts)}
