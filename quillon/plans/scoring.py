"""Scoring and sequential-selection queries: error rates of turn pairs, edit counts, recognition changes, greedy choices.

The DuckDB statements fill the textbook's table of edits row by row; sequential choices are tested against brute force."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import text as t
from ..operators import greedy, reports, selection
from ..sources.tables import materialize, pairs, table
from . import duck


def wer_rows(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumns({"r": m.words_of(F.col("reference")), "h": m.words_of(F.col("hypothesis"))})
    p = p.withColumn("distance", m.word_distance(F.col("r"), F.col("h")))
    return p.select("conv_id", "turn", "role", "distance", F.size("r").alias("words"), m.percent(F.col("distance"), F.size("r")).alias("wer"))


def cer_rows(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("distance", F.levenshtein("reference", "hypothesis"))
    return p.select("conv_id", "turn", "distance", F.length("reference").alias("characters"), m.percent(F.col("distance"), F.length("reference")).alias("cer"))


def edit_counts_rows(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("e", m.word_edits(F.col("reference"), F.col("hypothesis")))
    return p.select("conv_id", "turn", "e.*")


def summary(scored, *by):
    """Micro, macro and median rates and empties of scored rows, by groups."""
    sums = [F.sum("distance").alias("edits"), F.sum("words").alias("words"), F.avg("wer").alias("mean"), F.expr("median(wer)").alias("median"), F.count(F.lit(1)).alias("n")]
    out = scored.groupBy(*by).agg(*sums)
    return out.select(*by, "n", "edits", "words", m.rounded(m.percent(F.col("edits"), F.col("words")), 3).alias("corpus_wer"), m.rounded(F.col("mean"), 3).alias("mean_wer"), m.rounded(F.col("median"), 3).alias("median_wer"))


def wer_corpus_summary(spark, sf_dir):
    return summary(wer_rows(spark, sf_dir))


def wer_by_group(spark, sf_dir):
    return summary(wer_rows(spark, sf_dir), "role")


def wer_by_bucket(spark, sf_dir):
    return wer_rows(spark, sf_dir).groupBy(m.error_bucket(F.col("wer")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def recognition_change_counts(spark, sf_dir):
    """A turn as the reference, the one before as the base, the one after as the adapted hypothesis."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select(F.col("text").alias("reference"), F.lag("text").over(w).alias("base"), F.lead("text").over(w).alias("adapted")).where("base is not null and adapted is not null")
    return c.groupBy(m.recognition_change(F.col("reference"), F.col("base"), F.col("adapted")).alias("change")).agg(F.count(F.lit(1)).alias("n"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (-F.col("p_retailprice")).alias("rank"), F.split("p_type", " ").alias("tags"), F.col("p_brand").alias("domain"), F.col("p_size").alias("source"), F.col("p_name").alias("family"))


def _ranked(rows: pd.DataFrame) -> list[dict]:
    return rows.sort_values(["rank", "id"]).to_dict("records")


def _numbered(chosen: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"place": range(len(chosen)), "id": [r["id"] for r in chosen]})


def quota_selection(spark, sf_dir):
    quota = {"STEEL": 5, "BRASS": 5, "COPPER": 5}
    rows = selection.pruned_for_quota(_parts(spark, sf_dir), [F.col("rank"), F.col("id")], 60, quota)
    return selection.in_order(rows, lambda r: _numbered(selection.by_quota(_ranked(r), 60, quota)), "place long, id long")


def capped_greedy(spark, sf_dir):
    rows = greedy.category_candidates(_parts(spark, sf_dir), 40)
    return selection.in_order(rows, lambda r: _numbered(selection.with_category_cap(_ranked(r), 40, 12)), "place long, id long")


def relaxed_greedy(spark, sf_dir):
    """Cells by the first word of the type, each name once, under caps per brand and size."""
    rows = _parts(spark, sf_dir).select("id", "rank", F.col("tags")[0].alias("cell"), "domain", "source", "family", F.array(F.concat(F.lit("name "), "family")).alias("unique"))
    return greedy.relaxed_choice(rows, 60)[0]


def diversity_greedy(spark, sf_dir):
    def kernel(rows):
        ranked = [r | {"features": frozenset(r["tags"])} for r in _ranked(rows)]
        return _numbered(selection.with_diversity(ranked, 40, 15, {}))

    # rows with the same features are chosen in the order of their ranks
    rows = _parts(spark, sf_dir).withColumn("features", F.array_sort(F.array_distinct("tags")))
    rows = selection.pruned(rows, "features", [F.col("rank"), F.col("id")], 40)
    return selection.in_order(rows.drop("features"), kernel, "place long, id long")


def scored_parts(spark, sf_dir):
    """Names against types of parts: raw and normalised rates, and the four counts of edits."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("r"), F.col("p_type").alias("h"), F.split("p_type", " ").alias("tags"))
    for side in ("r", "h"):
        p = p.withColumn(f"{side}n", t.surface_form(F.col(side)))
    for kind, edits in (("words", m.word_edits), ("characters", m.character_edits)):
        p = p.withColumn(f"raw_{kind}", edits(F.col("r"), F.col("h"))).withColumn(f"normalised_{kind}", edits(F.col("rn"), F.col("hn")))
    sizes = {"raw_words": F.size(m.words_of(F.col("r"))), "normalised_words": F.size(m.words_of(F.col("rn"))), "raw_characters": F.length("r"), "normalised_characters": F.length("rn")}
    total = lambda k: F.col(k)["substitutions"] + F.col(k)["deletions"] + F.col(k)["insertions"]
    return p.select("p_partkey", "tags", *sizes, *(n.cast("long").alias(f"{k}_n") for k, n in sizes.items()), *(F.round(m.percent(total(k), n), 6).alias(f"{k}_rate") for k, n in sizes.items()))


def score_pairs(spark, sf_dir):
    p = scored_parts(spark, sf_dir)
    kinds = ("raw_words", "normalised_words", "raw_characters", "normalised_characters")
    return p.select("p_partkey", *(f"{k}_rate" for k in kinds), *(F.col(k)[e].cast("long").alias(f"{k}_{e[0]}") for k in kinds for e in ("substitutions", "deletions", "insertions")))


def scoring_report(spark, sf_dir):
    """The report of all parts' names against their types: brands are domains, words of the type tags, sizes durations."""
    rows = scored_parts(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") / 6).alias("duration"), (F.trim("p_type") == "").alias("empty")), "p_partkey")
    return reports.scoring_report(rows, "p_brand", "tags", "duration", "empty")


def capped_turns(spark, sf_dir):
    """Turns that are hardest against the turn before: empties first, then by character and word errors and deletions, of equal ones
    those whose rarest tag is chosen least; at most twelve of a role unless nothing else is left."""
    p = pairs(spark, sf_dir).withColumns({"e": m.word_edits(F.col("reference"), F.col("hypothesis")), "n": F.size(m.words_of(F.col("reference"))), "cd": F.levenshtein("reference", "hypothesis")})
    total = F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions")
    # rates in steps of five points, so that ties are frequent and the tags decide
    step = lambda d, n: F.floor(m.percent(d, n) / 5)
    rank = F.array(F.when(F.trim("hypothesis") == "", 0).otherwise(1).cast("long"), -step(F.col("cd"), F.length("reference")), -step(total, F.col("n")), -F.floor(F.col("e.deletions") / 10))
    tags = F.array("role", F.when(F.col("n") < 40, "short").when(F.col("n") < 120, "medium").otherwise("long"), F.when(F.length("hypothesis") % 3 == 0, "third").otherwise("other"))
    # written, as the candidates and their number ask for the rows several times, and edits would be counted each time
    scored = materialize(p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), rank.alias("rank"), tags.alias("tags")), "scored")
    rows = materialize(greedy.category_candidates(scored, 40), "candidates")

    def kernel(found):
        ranked = [r | {"rank": tuple(r["rank"]), "tags": list(r["tags"])} for r in found.to_dict("records")]
        return _numbered(selection.with_category_cap(ranked, 40, 12))

    return selection.in_order(rows, kernel, "place long, id long")


def score_by_tag(spark, sf_dir):
    """Micro and macro rates, raw and normalised, by each of a row's tags; a row counts under all of them."""
    p = scored_parts(spark, sf_dir).select("*", F.explode("tags").alias("tag"))
    total = lambda k: F.sum(F.col(k)["substitutions"] + F.col(k)["deletions"] + F.col(k)["insertions"])
    out = p.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), *(m.percent(total(k), F.sum(f"{k}_n")).alias(f"{k}_micro") for k in ("raw_words", "normalised_words", "normalised_characters")), *(F.avg(f"{k}_rate").alias(f"{k}_mean") for k in ("raw_words", "normalised_words")))
    return out.select("tag", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


_PAIR = "SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference, text AS hypothesis FROM conversations"
_WORDS = lambda x: f"list_filter(string_split_regex(coalesce({x}, ''), '{duck.S}+'), lambda x: x <> '')"
_WORD_PAIRS = "SELECT id, " + _WORDS("reference") + " AS r, " + _WORDS("hypothesis") + " AS h FROM q"
_EDITS = f"WITH RECURSIVE q AS (SELECT *, conv_id * 1000000 + turn AS id FROM ({_PAIR}) WHERE reference IS NOT NULL), {duck.edits(_WORD_PAIRS)}"
_SCORED = f"{_EDITS}, w AS (SELECT q.conv_id, q.turn, q.role, s + d + i AS distance, n AS words, {duck.percent('(s + d + i)', 'n')} AS wer FROM q JOIN edits USING (id))"
_DIGITS = "printf('%.3f', {x})::DOUBLE"
_SUMMARY = "count(*) AS n, sum(distance)::BIGINT AS edits, sum(words)::BIGINT AS words, " + ", ".join(_DIGITS.replace("{x}", x) + f" AS {k}_wer" for k, x in (("corpus", duck.percent("sum(distance)", "sum(words)")), ("mean", "avg(wer)"), ("median", "median(wer)"))) + " FROM w"
_CHANGE_PAIRS = "SELECT id * 2 AS id, " + _WORDS("reference") + " AS r, " + _WORDS("base") + " AS h FROM q UNION ALL SELECT id * 2 + 1, " + _WORDS("reference") + ", " + _WORDS("adapted") + " FROM q"
_PART_PAIRS = " UNION ALL ".join(f"SELECT p_partkey * 4 + {k}, {r}, {h} FROM q" if k else f"SELECT p_partkey * 4 AS id, {r} AS r, {h} AS h FROM q" for k, (r, h) in enumerate([(_WORDS("r"), _WORDS("h")), (_WORDS("rn"), _WORDS("hn")), ("string_split(r, '')", "string_split(h, '')"), ("string_split(rn, '')", "string_split(hn, '')")]))
_KINDS = ("raw_words", "normalised_words", "raw_characters", "normalised_characters")
_PARTS = f"WITH RECURSIVE q AS (SELECT p_partkey, p_type, p_name AS r, p_type AS h, {duck.surface('p_name')} AS rn, {duck.surface('p_type')} AS hn FROM part), {duck.edits(_PART_PAIRS)}, x AS (SELECT id // 4 AS p_partkey, id % 4 AS k, n, s, d, i, s + d + i AS e, round({duck.percent('(s + d + i)', 'n')}, 6) AS rate FROM edits)"
SQL = {
    "wer_rows": f"{_SCORED} SELECT conv_id, turn, role, distance, words, wer FROM w",
    "cer_rows": f"SELECT conv_id, turn, distance, characters, {duck.percent('distance', 'characters')} AS cer FROM (SELECT conv_id, turn, levenshtein({duck.one_byte('reference')}, {duck.one_byte('hypothesis')}) AS distance, length(reference) AS characters FROM ({_PAIR}) WHERE reference IS NOT NULL)",
    "edit_counts_rows": f"{_EDITS} SELECT q.conv_id, q.turn, s AS substitutions, d AS deletions, i AS insertions FROM q JOIN edits USING (id)",
    "wer_corpus_summary": f"{_SCORED} SELECT {_SUMMARY}",
    "wer_by_group": f"{_SCORED} SELECT role, {_SUMMARY} GROUP BY role",
    "wer_by_bucket": f"{_SCORED} SELECT CASE WHEN wer = 0 THEN '0' WHEN wer <= 25 THEN '0-25' WHEN wer <= 50 THEN '25-50' WHEN wer <= 75 THEN '50-75' WHEN wer <= 100 THEN '75-100' ELSE 'over-100' END AS bucket, count(*) AS n FROM w GROUP BY 1",
    "recognition_change_counts": f"""WITH RECURSIVE q AS (SELECT * FROM (SELECT conv_id * 1000000 + turn AS id, text AS reference, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS base, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS adapted FROM conversations) WHERE base IS NOT NULL AND adapted IS NOT NULL), {duck.edits(_CHANGE_PAIRS)},
w AS (SELECT id // 2 AS id, max({duck.percent('(s + d + i)', 'n')}) FILTER (id % 2 = 0) AS b, max({duck.percent('(s + d + i)', 'n')}) FILTER (id % 2 = 1) AS a FROM edits GROUP BY 1)
SELECT CASE WHEN trim(adapted) = '' THEN 'EMPTY_HYPOTHESIS' WHEN adapted = reference THEN 'EXACT_MATCH' WHEN a < b THEN 'IMPROVED' WHEN a > b THEN 'REGRESSED' ELSE 'UNCHANGED' END AS change, count(*) AS n FROM q JOIN w USING (id) GROUP BY 1""",
    "score_pairs": f"{_PARTS} SELECT p_partkey, " + ", ".join(f"max(rate) FILTER (k = {k}) AS {x}_rate" for k, x in enumerate(_KINDS)) + ", " + ", ".join(f"max({c}) FILTER (k = {k}) AS {x}_{c}" for k, x in enumerate(_KINDS) for c in "sdi") + " FROM x GROUP BY p_partkey",
    "score_by_tag": f"{_PARTS}, g AS (SELECT x.*, unnest(string_split(q.p_type, ' ')) AS tag FROM x JOIN q USING (p_partkey)) SELECT tag, count(*) FILTER (k = 0) AS n, " + ", ".join(f"round({duck.percent(f'sum(e) FILTER (k = {k})', f'sum(n) FILTER (k = {k})')}, 4) AS {_KINDS[k]}_micro" for k in (0, 1, 3)) + ", " + ", ".join(f"round(avg(rate) FILTER (k = {k}), 4) AS {_KINDS[k]}_mean" for k in (0, 1)) + " FROM g GROUP BY tag",
    "scoring_report": f"""{_PARTS}, l AS (SELECT p_partkey, 'totals' AS section, '' AS name FROM part UNION ALL SELECT p_partkey, 'domain', p_brand FROM part UNION ALL SELECT p_partkey, 'phenomenon', unnest(string_split(p_type, ' ')) FROM part),
j AS (SELECT l.section, l.name, x.* FROM l JOIN x USING (p_partkey)), c AS (SELECT section, name, k, sum(s) AS substitutions, sum(d) AS deletions, sum(i) AS insertions, sum(e) AS distance, avg(rate) AS mean, median(rate) AS median, {duck.percent('sum(e)', 'sum(n)')} AS corpus FROM j GROUP BY section, name, k),
u AS (SELECT section, name, [{', '.join(f"'{k}'" for k in _KINDS)}][k + 1] || '_' || f AS field, v AS value FROM (UNPIVOT (SELECT section, name, k, substitutions::DOUBLE AS substitutions, deletions::DOUBLE AS deletions, insertions::DOUBLE AS insertions, distance::DOUBLE AS distance, mean, median, corpus FROM c) ON substitutions, deletions, insertions, distance, mean, median, corpus INTO NAME f VALUE v)),
o AS (SELECT section, name, count(*)::DOUBLE AS rows, sum(p_size / 6) AS duration, count(*) FILTER (trim(p_type) = '')::DOUBLE AS empty FROM l JOIN part USING (p_partkey) GROUP BY section, name),
h AS (SELECT section, name, count(*) FILTER (k = 1 AND rate >= 100)::DOUBLE AS normalised_words_rate_ge_100, count(*) FILTER (k = 1 AND rate >= 75)::DOUBLE AS normalised_words_rate_ge_75, count(*) FILTER (k = 3 AND rate >= 50)::DOUBLE AS normalised_characters_rate_ge_50 FROM j GROUP BY section, name)
SELECT section, name, field, round(value, 6) AS value FROM u UNION ALL SELECT section, name, f, round(v, 6) FROM (UNPIVOT o ON rows, duration, empty INTO NAME f VALUE v) UNION ALL SELECT section, name, f, v FROM (UNPIVOT h ON COLUMNS('normalised.*') INTO NAME f VALUE v)
UNION ALL SELECT 'histogram', [{', '.join(f"'{k}'" for k in _KINDS)}][k + 1], CASE WHEN rate = 0 THEN '0' WHEN rate <= 25 THEN '0-25' WHEN rate <= 50 THEN '25-50' WHEN rate <= 75 THEN '50-75' WHEN rate <= 100 THEN '75-100' ELSE 'over-100' END, count(*)::DOUBLE FROM x GROUP BY ALL
UNION ALL SELECT 'histogram', 'duration', CASE WHEN p_size / 6 < 2.0 THEN 'short_lt_2s' WHEN p_size / 6 <= 5.0 THEN 'medium_2_to_5s' ELSE 'long_gt_5s' END, count(*)::DOUBLE FROM part GROUP BY ALL""",
    # a part's metal is the last word of its type and no other word is one, so the quotas don't meet
    "quota_selection": """WITH p AS (SELECT p_partkey AS id, p_retailprice AS price, string_split(p_type, ' ')[-1] AS metal FROM part),
q AS (SELECT id, price, CASE WHEN metal IN ('BRASS', 'COPPER', 'STEEL') AND row_number() OVER (PARTITION BY metal ORDER BY price DESC, id) <= 5 THEN metal END AS quota FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY quota NULLS LAST, price DESC, id) - 1 AS place FROM q) SELECT place, id FROM r WHERE place < 60""",
}
_ALL = (wer_rows, cer_rows, edit_counts_rows, wer_corpus_summary, wer_by_group, wer_by_bucket, recognition_change_counts, score_pairs, score_by_tag, scoring_report, capped_turns, quota_selection, capped_greedy, relaxed_greedy, diversity_greedy)
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in _ALL}
