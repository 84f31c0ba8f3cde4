"""Leakage and collision queries over documents as text records.

A record's keys come from the driver's columns: its source, its language with a band of lengths as the source id, the opening and the close of its text, a
declared family where the length is a round number, a recording where the text is long; fingerprints are those of the four views.
A minimal pair is ten neighbours of one language; its review is the row's labels."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import leakage
from ..sources.tables import materialize, role, table
from . import duck

KEYS = ("id", "source_id", "source_family_id", "utterance_family_id", "declared_template_family", "discovered_template_family", "surface", "number_masked", "entity_masked", "carrier_stripped", "source_recording_id")
PAIRS = [("selected_training", "synthetic_holdout"), ("synthetic_candidate", "synthetic_holdout")]
VIEWS = {"surface": False, "number_masked": True, "entity_masked": True, "carrier_stripped": True}
MOST = 4


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("s", t.surface_form(t.composed(F.coalesce("text", F.lit("")))))
    d = materialize(d.select("doc_id", "lang", "source", "n_chars", "s", t.masked(F.col("s")).alias("m")), "records")
    d = d.withColumns({"e": t.masked(F.col("m")), "c": t.carrier_free(F.col("m")), "w": t.tokens(F.col("s"))})
    return d.select(
        F.col("doc_id").alias("candidate_id"), role(F.col("doc_id")).alias("partition_role"), F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 100).cast("string")).alias("source_id"), F.col("source").alias("source_family_id"),
        F.concat_ws(" ", F.slice("w", 1, 2), F.lit("|"), F.reverse(F.slice(F.reverse("w"), 1, 3))).alias("utterance_family_id"),
        F.when(F.col("n_chars") % 50 == 0, F.concat(F.lit("declared-"), "n_chars")).otherwise(F.lit("")).alias("declared_template_family"),
        t.template_family(F.col("e")).alias("discovered_template_family"),
        *(t.fingerprint(F.col(c)).alias(n) for c, n in (("s", "surface"), ("m", "number_masked"), ("e", "entity_masked"), ("c", "carrier_stripped"))),
        F.when(F.col("n_chars") > 2000, F.concat(F.lit("rec-"), "n_chars")).alias("source_recording_id"),
        F.when(F.col("doc_id") % 11 != 0, F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 10).cast("string"))).alias("family"),
    )


def leak_keys(spark, sf_dir):
    """Training and candidate rows that share one of eleven keys with the holdout, and the last holdout row of that key."""
    return leakage.cross_partition(_records(spark, sf_dir), list(KEYS), PAIRS)


def absent_from_pool(spark, sf_dir):
    """Training rows whose source has no candidate."""
    return leakage.absent_sources(_records(spark, sf_dir), "selected_training", "synthetic_candidate", "source_id").select("candidate_id", "source_id")


def view_collisions(spark, sf_dir):
    """Groups that agree in one of four views within a partition, but for approved minimal pairs."""
    reviews = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("candidate_id")).agg(F.every((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"))
    return leakage.collisions(_records(spark, sf_dir).join(reviews, "candidate_id", "left"), VIEWS, F.col("family"), F.col("accepted"), MOST)


def view_counts(spark, sf_dir):
    """Distinct fingerprints of four views, by partition and over all."""
    return leakage.distinct_counts(_records(spark, sf_dir), list(VIEWS))


def _against_gate(spark, sf_dir):
    """Records and, as candidates, every protected text as it might leak: shouted, with a full stop for each comma and other numbers."""
    gate = table(spark, sf_dir, "benchmark").select("item_id", t.surface_form(t.composed(F.coalesce("text", F.lit("")))).alias("s"))
    leaked = table(spark, sf_dir, "benchmark").select((F.col("item_id") + LEAKED).alias("candidate_id"), F.concat(F.translate(F.coalesce("text", F.lit("")), ascii_lowercase + ",", ascii_uppercase + "."), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), "item_id")).otherwise(F.lit(""))).alias("text"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), F.coalesce("text", F.lit("")).alias("text")).unionAll(leaked)
    rows = rows.select("candidate_id", role(F.col("candidate_id")).alias("partition_role"), t.surface_form(t.composed(F.col("text"))).alias("s"))
    with_number = gate.select("item_id", F.concat("s", F.lit(" 7")).alias("s"))  # a protected text that ends in a number
    return materialize(rows, "rows"), materialize(gate.unionAll(with_number), "gate")


LEAKED = 10_000_000


def leak_surface(spark, sf_dir):
    """Rows whose surface form is a protected text's; of equal protected texts the first is named."""
    rows, gate = _against_gate(spark, sf_dir)
    known = gate.groupBy(t.fingerprint(F.col("s")).alias("h")).agg(F.min("item_id").alias("item_id"))
    found = rows.join(known, t.fingerprint(rows["s"]) == F.col("h"))
    return found.select("candidate_id", "partition_role", "item_id", F.lit("protected_surface_overlap").alias("code"), F.lit("failed").alias("severity"))


def leak_number_masked(spark, sf_dir):
    """Rows that equal a protected text but for its numbers, without those that equal it whole."""
    rows, gate = _against_gate(spark, sf_dir)
    known = gate.select(t.fingerprint(t.masked(F.col("s"))).alias("h")).distinct()
    whole = gate.select(t.fingerprint(F.col("s")).alias("w")).distinct()
    found = rows.join(known, t.fingerprint(t.masked(rows["s"])) == F.col("h"), "left_semi").join(whole, t.fingerprint(rows["s"]) == F.col("w"), "left_anti")
    return found.select("candidate_id", "partition_role", F.lit("protected_number_masked_overlap").alias("code"), F.lit("review_required").alias("severity"))


def join_missing_unexpected(spark, sf_dir):
    """Parts without an order of the last quarter, and reviewed documents that are shorter than any that may be reviewed."""
    late = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    missing = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(late, "id", "left_anti")
    allowed = table(spark, sf_dir, "documents").where("n_chars >= 400").select(F.col("doc_id").alias("id"))
    unexpected = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).join(allowed, "id", "left_anti")
    return missing.select(F.lit("missing").alias("side"), "id").unionAll(unexpected.select(F.lit("unexpected"), "id"))


def view_key_guard(spark, sf_dir):
    """Combinations of four keys that occur more than once, which a schedule may not join on."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_FREE = r"""regexp_replace(regexp_replace(regexp_replace(m, '(?i)\bskupina\s+<NUM>\s+pove\s+da\b', ' ', 'g'), '(?i)\bpri\s+postaji\s+<NUM>\s+pri\s+postaji\s+<NUM>', ' ', 'g'), '(?i)\b(candidate|row|group|batch|sample)\s+<NUM>', ' ', 'g')"""
_RECORDS = f"""d AS (SELECT *, {duck.surface("nfc_normalize(coalesce(text, ''))")} AS s FROM documents), e AS (SELECT *, {duck.masked('s')} AS m, {duck.tokens('s')} AS w FROM d), f AS (SELECT *, {duck.surface(_FREE)} AS c FROM e),
r AS (SELECT doc_id AS candidate_id, {duck.role()} AS role, doc_id::VARCHAR AS k_id, concat_ws(':', lang, (n_chars // 100)::VARCHAR) AS k_source_id, source AS k_source_family_id,
  concat_ws(' ', nullif(array_to_string(w[1:2], ' '), ''), '|', nullif(array_to_string(w[-3:], ' '), '')) AS k_utterance_family_id, CASE WHEN n_chars % 50 = 0 THEN 'declared-' || n_chars ELSE '' END AS k_declared_template_family,
  'dtf-' || substr(sha256(m), 1, 16) AS k_discovered_template_family, sha256(s) AS k_surface, sha256(m) AS k_number_masked, sha256(m) AS k_entity_masked, sha256(c) AS k_carrier_stripped,
  CASE WHEN n_chars > 2000 THEN 'rec-' || n_chars END AS k_source_recording_id, CASE WHEN doc_id % 11 <> 0 THEN concat_ws('-', lang, (doc_id // 10)::VARCHAR) END AS family FROM f),
u AS (UNPIVOT r ON COLUMNS('k_.*') INTO NAME k VALUE v)"""
_GATE = f"""gate AS (SELECT item_id, {duck.surface("nfc_normalize(coalesce(text, ''))")} || x AS s FROM benchmark, (VALUES (''), (' 7')) v(x)),
x AS (SELECT candidate_id, {duck.surface("nfc_normalize(text)")} AS s FROM (SELECT doc_id AS candidate_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id + {LEAKED}, translate(coalesce(text, ''), '{ascii_lowercase},', '{ascii_uppercase}.') || CASE WHEN item_id % 2 = 0 THEN ' ' || item_id ELSE '' END FROM benchmark))"""
SQL = {
    "leak_keys": f"""WITH {_RECORDS} SELECT 'cross_partition_' || substr(a.k, 3) || '_overlap' AS code, a.role || '/synthetic_holdout' AS partition_role, a.candidate_id, max(b.candidate_id) AS related_id
FROM u a JOIN u b ON a.k = b.k AND a.v = b.v AND b.role = 'synthetic_holdout' AND a.role <> b.role WHERE a.v <> '' GROUP BY a.k, a.role, a.candidate_id""",
    "absent_from_pool": f"WITH {_RECORDS} SELECT candidate_id, k_source_id AS source_id FROM r WHERE role = 'selected_training' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.role = 'synthetic_candidate' AND b.k_source_id = r.k_source_id)",
    "view_collisions": f"""WITH {_RECORDS}, v AS (SELECT doc_id AS candidate_id, bool_and(quality = 1 AND toxic = 0) AS ok FROM labels GROUP BY doc_id),
x AS (SELECT u.*, coalesce(ok, false) AND family IS NOT NULL AS ok2 FROM u LEFT JOIN v USING (candidate_id) WHERE k IN ('k_surface', 'k_number_masked', 'k_entity_masked', 'k_carrier_stripped')),
g AS (SELECT role, k, v, list(candidate_id ORDER BY candidate_id) AS ids, count(*) AS n, bool_and(ok2) AND count(DISTINCT family) = 1 AND count(*) <= {MOST} AS exempt FROM x GROUP BY role, k, v)
SELECT 'within_partition_' || substr(k, 3) || '_collision' AS code, role AS partition_role, ids[1] AS candidate_id, ids[2] AS related_id, n FROM g WHERE n > 1 AND NOT (exempt AND k <> 'k_surface')""",
    "view_counts": f"WITH {_RECORDS} SELECT role AS partition_role, substr(k, 3) AS \"view\", count(*) AS rows, count(DISTINCT v) AS distinct_values FROM u WHERE k IN ('k_surface', 'k_number_masked', 'k_entity_masked', 'k_carrier_stripped') GROUP BY GROUPING SETS ((role, k), (k))",
    "leak_surface": f"WITH {_GATE} SELECT candidate_id, {duck.role('candidate_id')} AS partition_role, (SELECT min(item_id) FROM gate WHERE gate.s = x.s) AS item_id, 'protected_surface_overlap' AS code, 'failed' AS severity FROM x WHERE s IN (SELECT s FROM gate)",
    "leak_number_masked": f"WITH {_GATE}, y AS (SELECT *, {duck.masked('s')} AS m FROM x), k AS (SELECT {duck.masked('s')} AS m FROM gate) SELECT candidate_id, {duck.role('candidate_id')} AS partition_role, 'protected_number_masked_overlap' AS code, 'review_required' AS severity FROM y WHERE m IN (SELECT m FROM k) AND s NOT IN (SELECT s FROM gate)",
    "join_missing_unexpected": "SELECT 'missing' AS side, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) UNION ALL SELECT 'unexpected', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 400)",
    "view_key_guard": "SELECT DISTINCT a.l_returnflag, a.l_linestatus, a.l_suppkey, a.l_partkey, count(*) OVER (PARTITION BY a.l_returnflag, a.l_linestatus, a.l_suppkey, a.l_partkey) AS n FROM lineitem a QUALIFY n > 1",
}
QUERIES = {f.__name__: (f, SQL[f.__name__]) for f in (leak_keys, absent_from_pool, view_collisions, view_counts, leak_surface, leak_number_masked, join_missing_unexpected, view_key_guard)}
