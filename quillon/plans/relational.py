"""Relational queries: joins, aggregates, windows, selection, schedules, decisions and leakage.

Each is one statement written once; a dialect object gives the few spellings in which Spark and DuckDB differ. The Spark
text goes to Catalyst as it is; the DuckDB text is the oracle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.tables import table
from . import duck


def _composed(spark: SparkSession, sf_dir: str) -> str:
    """A view of the documents with texts in NFC."""
    d = table(spark, sf_dir, "documents")
    name = f"composed_{hashlib.md5(sf_dir.encode()).hexdigest()}"
    d.withColumn("text", t.composed(F.col("text"))).createOrReplaceTempView(name)
    return name


def _spark(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    surface = "trim(regexp_replace(lower({x}), '[^\\\\p{L}\\\\p{N}_]+', ' '))"
    return SimpleNamespace(
        spark=True,
        composed=lambda: _composed(spark, sf_dir),
        t=lambda name: f"parquet.`{sf_dir}/{name}.parquet`",
        sha=lambda x: f"sha2({x}, 256)",
        hex=lambda x, n: f"cast(conv(substr(sha2({x}, 256), 1, {n}), 16, 10) AS bigint)",
        digest=lambda x, order, sep: f"sha2(array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), e -> e.v), '{sep}'), 256)",
        surface=lambda x: surface.replace("{x}", x),
        words=lambda x: f"filter(split({x}, ' '), w -> w <> '')",
        explode=lambda x: f"explode({x})",
        pick=lambda options, i: f"element_at(array({', '.join(options)}), cast({i} AS int))",
        series=lambda a, b: f"explode(sequence({a}, {b}))",
        day=lambda x: f"cast({x} AS date)",
        div=lambda a, b: f"(({a}) div ({b}))",
        half_even=lambda x, n: f"cast(replace(format_number({x}, {n}), ',', '') AS double)",
        text=lambda x: f"cast({x} AS string)",
        lpad=lambda x, n: f"lpad({x}, {n}, '0')",
        at=lambda x, order, i: f"element_at(sort_array(collect_list({x})), cast({i} AS int))",
        labels=lambda *pairs: "array_join(array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{l}' END" for l, c in pairs) + ")), ';')",
        seconds=lambda x: f"unix_timestamp({x})",
        json_k=lambda x: f"cast(get_json_object({x}, '$.k') AS bigint)",
        floor_to=lambda x, s: f"((unix_timestamp({x}) div {s}) * {s})",
    )


DUCK = SimpleNamespace(
    spark=False,
    composed=lambda: "(SELECT * REPLACE (nfc_normalize(text) AS text) FROM documents)",
    t=lambda name: name,
    sha=lambda x: f"sha256({x})",
    hex=lambda x, n: f"(('0x' || substr(sha256({x}), 1, {n}))::bigint)",
    digest=lambda x, order, sep: f"sha256(string_agg({x}, '{sep}' ORDER BY {order}, {x}))",
    surface=duck.surface,
    words=lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')",
    explode=lambda x: f"unnest({x})",
    pick=lambda options, i: f"[{', '.join(options)}][{i}]",
    series=lambda a, b: f"unnest(generate_series({a}, {b}))",
    day=lambda x: f"({x})::date",
    div=lambda a, b: f"(({a}) // ({b}))",
    half_even=lambda x, n: f"printf('%.{n}f', {x})::double",
    text=lambda x: f"({x})::varchar",
    lpad=lambda x, n: f"lpad({x}, {n}, '0')",
    at=lambda x, order, i: f"list({x} ORDER BY {x})[{i}]",
    labels=lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{l}' END" for l, c in pairs) + "], lambda x: x IS NOT NULL), ';')",
    seconds=lambda x: f"floor(epoch({x}))::bigint",
    json_k=lambda x: f"(json_extract_string({x}, '$.k')::bigint)",
    floor_to=lambda x, s: f"((floor(epoch({x}))::bigint // {s}) * {s})",
)

#: Statements by name; each takes a dialect.
STATEMENTS: dict[str, Callable[[SimpleNamespace], str]] = {}


def statement(make: Callable[[SimpleNamespace], str]) -> Callable[[SimpleNamespace], str]:
    STATEMENTS[make.__name__] = make
    return make


ROLE = duck.role()


def _docs(d, text: str = "text") -> str:
    """Documents with role, surface form and its hash."""
    return f"docs AS (SELECT doc_id, lang, source, n_chars, {ROLE} AS role, {d.surface(f'coalesce({text}, {chr(39) * 2})')} AS s FROM {d.composed()}), fp AS (SELECT *, {d.sha('s')} AS h FROM docs)"


# ---- fingerprints and exact duplicates


@statement
def fp_unique_counts(d):
    return f"WITH {_docs(d)} SELECT role AS partition_role, count(*) AS rows, count(DISTINCT h) AS surfaces, count(DISTINCT substr(h, 1, 16)) AS families FROM fp GROUP BY role"


@statement
def fp_family_summary(d):
    return f"WITH {_docs(d)}, g AS (SELECT role, concat('dtf-', substr(h, 1, 16)) AS family, count(*) AS n FROM fp GROUP BY role, concat('dtf-', substr(h, 1, 16))) SELECT role AS partition_role, count(*) AS families, max(n) AS largest, round(max(n) / cast(sum(n) AS double), 6) AS largest_fraction FROM g GROUP BY role"


@statement
def family_concentration(d):
    return f"WITH {_docs(d)}, g AS (SELECT role, substr(h, 1, 16) AS family, count(*) AS n FROM fp GROUP BY role, substr(h, 1, 16)), t AS (SELECT role, sum(n) AS total FROM g GROUP BY role) SELECT g.role AS partition_role, family, n, CASE WHEN n >= 3 AND n > 0.05 * total THEN 'failed' ELSE 'review_required' END AS severity FROM g JOIN t ON g.role = t.role WHERE n >= 3"


@statement
def dedup_exact_groups(d):
    return f"WITH {_docs(d)} SELECT role AS partition_role, h AS fingerprint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, bool_and(lang = 'en') AS all_approved FROM fp GROUP BY role, h HAVING count(*) > 1"


@statement
def dedup_first_wins(d):
    return f"WITH {_docs(d)} SELECT doc_id, h AS surface_hash FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM fp) x WHERE rn = 1"


@statement
def dedup_reject_reasons(d):
    """The ordered cascade: rows that fail a rule of their own never count as seen; then the first of each class stays."""
    b = f"(SELECT DISTINCT {d.sha(d.surface('text'))} AS h FROM {d.t('benchmark')})"
    return f"""WITH {_docs(d)},
p AS (SELECT fp.*, b.h IS NOT NULL AS guarded, coalesce(n_chars, 0) < 40 AS invalid, source = 'src3' AS carrier FROM fp LEFT JOIN {b} b ON fp.h = b.h),
e AS (SELECT *, min(CASE WHEN NOT invalid AND NOT guarded AND NOT carrier THEN doc_id END) OVER (PARTITION BY h) AS first_kept FROM p),
r AS (SELECT doc_id, lang, CASE WHEN invalid THEN 'schema_invalid' WHEN first_kept < doc_id THEN 'surface_duplicate' WHEN carrier THEN 'prohibited_carrier' WHEN guarded THEN 'protected_surface_overlap' ELSE 'retained' END AS reason FROM e)
SELECT lang AS cell, reason, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY lang, reason"""


@statement
def dedup_duplicate_ids_prev(d):
    return f"SELECT * FROM (SELECT l_orderkey AS candidate_id, l_linenumber AS ordinal, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS related_ordinal FROM {d.t('lineitem')}) x WHERE related_ordinal IS NOT NULL"


@statement
def dup_hash_groups_explained(d):
    return f"WITH {_docs(d)}, raw AS (SELECT doc_id, h, source FROM fp) SELECT h AS audio_sha256, count(*) AS n, count(DISTINCT source) AS keys, CASE WHEN count(DISTINCT source) = 1 THEN 'explained' ELSE 'unexplained' END AS kind, count(*) - 1 AS extras FROM raw GROUP BY h HAVING count(*) > 1"


# ---- leakage


@statement
def leak_surface(d):
    return f"WITH {_docs(d)}, b AS (SELECT {d.sha(d.surface('text'))} AS h, min(item_id) AS item_id FROM {d.t('benchmark')} GROUP BY 1) SELECT doc_id AS candidate_id, role AS partition_role, item_id, 'protected_surface_overlap' AS code, 'failed' AS severity FROM fp JOIN b ON fp.h = b.h"


@statement
def leak_cross_partition_keys(d):
    """Left rows whose key exists in another partition; the related id is the last of the key."""
    keys = "SELECT doc_id, role, 'surface' AS k, h AS v FROM fp UNION ALL SELECT doc_id, role, 'family', substr(h, 1, 16) FROM fp UNION ALL SELECT doc_id, role, 'length_source', concat(source, ':', cast(n_chars AS varchar(20))) FROM fp WHERE coalesce(source, '') <> ''"
    return f"""WITH {_docs(d)}, keys AS ({keys}),
r AS (SELECT role, k, v, max(doc_id) AS related_id FROM keys GROUP BY role, k, v),
pairs AS (SELECT 'synthetic_candidate' AS a, 'synthetic_holdout' AS b UNION ALL SELECT 'selected_training', 'synthetic_holdout')
SELECT a AS left_role, b AS right_role, x.k AS key_name, x.doc_id AS candidate_id, r.related_id FROM pairs JOIN keys x ON x.role = pairs.a JOIN r ON r.role = pairs.b AND r.k = x.k AND r.v = x.v"""


@statement
def leak_overlap_counts(d):
    sides = "max(CASE WHEN role = 'synthetic_holdout' THEN 1 ELSE 0 END) AS b, max(CASE WHEN role <> 'synthetic_holdout' THEN 1 ELSE 0 END) AS a"
    return f"WITH {_docs(d)}, k AS (SELECT 'surface' AS k, h AS v, role FROM fp UNION ALL SELECT 'source', source, role FROM fp WHERE coalesce(source, '') <> ''), s AS (SELECT k, v, {sides} FROM k GROUP BY k, v) SELECT k AS key_name, count(*) AS distinct_values, sum(a * b) AS overlap FROM s GROUP BY k"


@statement
def leak_holdout_priority_reason(d):
    return f"""WITH {_docs(d)}, c AS (SELECT DISTINCT h FROM fp WHERE role <> 'synthetic_holdout'), n AS (SELECT DISTINCT n_chars FROM fp WHERE role <> 'synthetic_holdout')
SELECT doc_id, CASE WHEN c.h IS NOT NULL THEN 'candidate_surface_overlap' WHEN n.n_chars IS NOT NULL THEN 'candidate_length_overlap' END AS reason
FROM fp LEFT JOIN c ON fp.h = c.h LEFT JOIN n ON fp.n_chars = n.n_chars WHERE role = 'synthetic_holdout' AND (c.h IS NOT NULL OR n.n_chars IS NOT NULL)"""


# ---- reviews and statuses

OUTCOME = "CASE WHEN toxic = 1 THEN 'REJECT_SEMANTICS' WHEN quality = 1 THEN 'ACCEPT' WHEN quality = 0 THEN 'REVISE_AND_REREVIEW' END"


@statement
def review_coverage(d):
    return f"SELECT CASE WHEN x.doc_id IS NULL THEN 'unknown' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'covered' END AS status, count(*) AS n, min(coalesce(x.doc_id, l.doc_id)) AS first_id FROM {d.t('documents')} x FULL OUTER JOIN {d.t('labels')} l ON x.doc_id = l.doc_id GROUP BY 1"


@statement
def review_outcomes(d):
    return f"SELECT {ROLE.replace('doc_id', 'x.doc_id')} AS partition_role, coalesce({OUTCOME}, 'MISSING') AS outcome, count(*) AS n FROM {d.t('documents')} x LEFT JOIN {d.t('labels')} l ON x.doc_id = l.doc_id GROUP BY 1, 2"


@statement
def review_accept_reject(d):
    """All or nothing: a repeated review would be a hard issue, and then nothing is accepted."""
    return f"""WITH h AS (SELECT count(*) - count(DISTINCT doc_id) AS repeats FROM {d.t('labels')})
SELECT x.doc_id, {OUTCOME} AS outcome, ({OUTCOME}) = 'ACCEPT' AND h.repeats = 0 AS accepted FROM {d.t('documents')} x JOIN {d.t('labels')} l ON x.doc_id = l.doc_id CROSS JOIN h"""


#: Admission checks: name, code, severity and when a row has the issue.
CHECKS = (
    ("exact_groups", "exact_surface_collision", "failed", "doc_id > keep"),
    ("cross_partition", "cross_partition_overlap", "failed", "role <> 'synthetic_holdout' AND held > 0"),
    ("protected_indexes", "protected_surface_overlap", "failed", "guarded"),
    ("record_contract", "word_count_outside_limits", "review_required", "s = '' OR n_chars > 20000"),
    ("linguistic_review", "review_missing", "not_run", "NOT reviewed"),
)


def _issues(d) -> str:
    """One pass: what a row needs to know of others comes by windows over its hash and by joins; then its issues are laid out in rows."""
    if d.spark:
        cells = ", ".join(f"CASE WHEN {when} THEN named_struct('check_', '{c}', 'code', '{code}', 'severity', '{sev}') END" for c, code, sev, when in CHECKS)
        laid = f"SELECT role, doc_id, i.check_, i.code, i.severity FROM e LATERAL VIEW inline(array_compact(array({cells}))) i AS check_, code, severity"
    else:
        cells = ", ".join(f"CASE WHEN {when} THEN {{'check_': '{c}', 'code': '{code}', 'severity': '{sev}'}} END" for c, code, sev, when in CHECKS)
        laid = f"SELECT role, doc_id, i.check_, i.code, i.severity FROM (SELECT role, doc_id, unnest(list_filter([{cells}], lambda x: x IS NOT NULL)) AS i FROM e) x"
    return f"""{_docs(d)},
b AS (SELECT DISTINCT {d.sha(d.surface('text'))} AS h FROM {d.t('benchmark')}), l AS (SELECT DISTINCT doc_id FROM {d.t('labels')}),
e AS (SELECT fp.doc_id, fp.role, fp.s, fp.n_chars, b.h IS NOT NULL AS guarded, l.doc_id IS NOT NULL AS reviewed, min(fp.doc_id) OVER (PARTITION BY fp.h, fp.role) AS keep,
  sum(CASE WHEN fp.role = 'synthetic_holdout' THEN 1 ELSE 0 END) OVER (PARTITION BY fp.h) AS held FROM fp LEFT JOIN b ON fp.h = b.h LEFT JOIN l ON fp.doc_id = l.doc_id),
issues AS ({laid})"""


SEVERITY = "CASE severity WHEN 'failed' THEN 4 WHEN 'blocked' THEN 3 WHEN 'not_run' THEN 2 WHEN 'review_required' THEN 1 END"


@statement
def admission_report(d):
    """Issue counts of the admission checks by code, severity and role."""
    return f"WITH {_issues(d)} SELECT check_ AS check_name, code, severity, role AS partition_role, count(*) AS n, min(doc_id) AS first_id FROM issues GROUP BY check_, code, severity, role"


@statement
def check_status_rollup(d):
    names = " UNION ALL ".join(f"SELECT '{c}' AS check_name" for c in ("exact_groups", "cross_partition", "protected_indexes", "record_contract", "linguistic_review", "metadata_leakage"))
    return f"WITH {_issues(d)}, names AS ({names}), m AS (SELECT check_, max({SEVERITY}) AS worst FROM issues GROUP BY check_) SELECT check_name, CASE worst WHEN 4 THEN 'FAILED' WHEN 3 THEN 'BLOCKED' WHEN 2 THEN 'NOT_RUN' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'PASSED' END AS status FROM names LEFT JOIN m ON check_name = check_"


@statement
def admission_status(d):
    return f"WITH {_issues(d)} SELECT role AS partition_role, count(*) AS issues, CASE WHEN max({SEVERITY}) = 4 THEN 'TEXT_REJECTED' WHEN max({SEVERITY}) IS NOT NULL THEN 'DRAFT' ELSE 'TEXT_ACCEPTED' END AS status FROM issues GROUP BY role"


# ---- joins


@statement
def join_manifest_full(d):
    return f"""SELECT CASE WHEN c_custkey IS NULL THEN 'unexpected' WHEN o_custkey IS NULL THEN 'missing' WHEN total < 0 THEN 'mismatch' ELSE 'matched' END AS status, count(*) AS n, sum(coalesce(orders, 0)) AS orders
FROM {d.t('customer')} FULL OUTER JOIN (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM {d.t('orders')} GROUP BY o_custkey) o ON c_custkey = o_custkey GROUP BY 1"""


@statement
def join_missing_unexpected(d):
    anti = "LEFT ANTI JOIN" if d.spark else "ANTI JOIN"
    return f"SELECT 'missing' AS side, c_custkey AS id FROM {d.t('customer')} {anti} {d.t('orders')} ON c_custkey = o_custkey UNION ALL SELECT 'unexpected', doc_id FROM {d.t('labels')} {anti} {d.t('documents')} x USING (doc_id)"


@statement
def join_schedule_views(d):
    """A schedule against views on four keys and texts on one; unmatched rows would be errors."""
    return f"SELECT o_orderpriority AS round, l_returnflag AS view_type, count(*) AS n, count(p_partkey) AS matched, sum(l_quantity) AS quantity FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey LEFT JOIN {d.t('part')} ON l_partkey = p_partkey GROUP BY 1, 2"


@statement
def view_key_guard(d):
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM {d.t('lineitem')} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"


@statement
def bank_completeness(d):
    return f"SELECT l_partkey AS semantic_key, count(DISTINCT l_returnflag) AS voices, CASE WHEN count(DISTINCT l_returnflag) = 3 THEN 'complete' ELSE 'incomplete' END AS status, count(DISTINCT l_suppkey) AS hashes FROM {d.t('lineitem')} GROUP BY l_partkey"


@statement
def whole_file_decision(d):
    return f"WITH n AS (SELECT count(*) AS rows FROM {d.t('benchmark')}) SELECT item_id AS candidate_id, 'ACCEPT' AS outcome, 'revision-1' AS review_revision, rows FROM {d.t('benchmark')} CROSS JOIN n"


@statement
def directional_suite(d):
    """Union of splits, ids made anew per split, one global place."""
    return f"""WITH u AS (SELECT 'benchmark' AS split, 0 AS o, item_id AS id FROM {d.t('benchmark')} UNION ALL SELECT 'holdout', 1, doc_id FROM {d.t('documents')} WHERE doc_id % 10 = 0),
k AS (SELECT split, o, id, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS i FROM u), n AS (SELECT split, count(*) AS c FROM u GROUP BY split)
SELECT concat(k.split, ':', {d.lpad(d.text('i'), 4)}) AS sample_id, k.split, id, i + CASE WHEN o = 0 THEN 0 ELSE (SELECT c FROM n WHERE split = 'benchmark') END AS position FROM k"""


@statement
def set_overlaps(d):
    return f"SELECT (SELECT count(*) FROM (SELECT doc_id FROM {d.t('documents')} INTERSECT SELECT doc_id FROM {d.t('labels')}) x) AS both_sides, (SELECT count(*) FROM (SELECT doc_id FROM {d.t('documents')} EXCEPT SELECT doc_id FROM {d.t('labels')}) x) AS only_left, (SELECT count(*) FROM (SELECT text FROM {d.t('documents')} UNION SELECT text FROM {d.t('benchmark')}) x) AS distinct_union"


# ---- aggregates


@statement
def hist_error_buckets(d):
    v = "l_discount * 1200"
    return f"SELECT CASE WHEN {v} = 0 THEN '0' WHEN {v} <= 25 THEN '0-25' WHEN {v} <= 50 THEN '25-50' WHEN {v} <= 75 THEN '50-75' WHEN {v} <= 100 THEN '75-100' ELSE 'over-100' END AS bucket, count(*) AS n FROM {d.t('lineitem')} GROUP BY 1"


@statement
def hist_duration_buckets(d):
    v = "n_chars / 150.0"
    return f"SELECT lang, CASE WHEN {v} < 2.0 THEN 'short_lt_2s' WHEN {v} <= 5.0 THEN 'medium_2_to_5s' ELSE 'long_gt_5s' END AS bucket, count(*) AS n FROM {d.t('documents')} GROUP BY 1, 2"


@statement
def dist_values(d):
    return f"SELECT l_returnflag, count(*) AS n, min(l_quantity) AS least, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity) AS p95, max(l_quantity) AS most, sum(l_quantity) AS total FROM {d.t('lineitem')} GROUP BY 1"


@statement
def dist_nearest_rank(d):
    qs = ", ".join(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY value) AS p{q}" for q in (5, 33, 50, 95))
    return f"SELECT event_type, {qs} FROM {d.t('events')} GROUP BY 1"


def _rank(d, index: str) -> str:
    """The value at a place of each group's order, by rank instead of a collected list."""
    return f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {d.t('events')} WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN i = {index} THEN value END) AS p95, max(n) AS n FROM r GROUP BY event_type"


@statement
def dist_floor_rank(d):
    return _rank(d, "least(n - 1, cast(floor(0.95 * n) AS bigint))")


@statement
def dist_bankers_rank(d):
    return _rank(d, f"cast({d.half_even('(n - 1) * 0.95', 0)} AS bigint)")


@statement
def monitor_summary(d):
    """A monitor's samples: numeric cells only, peak, mean and the share of busy samples."""
    v = "try_cast(value AS double)"
    return f"SELECT event_type, count({v}) AS samples, max({v}) AS peak, round(avg({v}), 6) AS mean, round(avg(CASE WHEN {v} >= 80 THEN cast(1 AS double) ELSE cast(0 AS double) END), 9) AS busy_fraction, sum({d.json_k('props')}) AS k FROM {d.t('events')} GROUP BY 1"


@statement
def set_digest(d):
    line = "concat(p_brand, '|', p_type)"
    return f"WITH x AS (SELECT DISTINCT p_brand, {line} AS line FROM {d.t('part')}) SELECT p_brand, count(*) AS n, {d.digest('line', 'line', chr(10))} AS digest FROM x GROUP BY 1".replace("\n", "\\n" if d.spark else "\n")


@statement
def ordered_digest(d):
    return f"SELECT conv_id, count(*) AS n, {d.digest('role', 'turn', ':')} AS digest FROM {d.t('conversations')} GROUP BY 1"


@statement
def densified_counts(d):
    return f"WITH c AS (SELECT DISTINCT l.lang, s.source FROM (SELECT DISTINCT lang FROM {d.t('documents')}) l CROSS JOIN (SELECT DISTINCT source FROM {d.t('documents')}) s), n AS (SELECT lang, source, count(*) AS n FROM {d.t('documents')} WHERE n_chars > 3000 GROUP BY 1, 2) SELECT c.lang, c.source, coalesce(n, 0) AS n FROM c LEFT JOIN n ON c.lang = n.lang AND c.source = n.source"


@statement
def multi_value_counts(d):
    return f"SELECT tag, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM (SELECT p_retailprice, {d.explode(d.words('p_type'))} AS tag FROM {d.t('part')}) x GROUP BY tag"


@statement
def metric_groups(d):
    """Micro and macro rates by domain, by tag and over all, in one pass of grouping sets."""
    e, n = "cast(l_linenumber AS bigint)", "l_quantity"
    return f"SELECT l_returnflag, l_linestatus, sum({e}) AS edits, sum({n}) AS words, {d.half_even(f'sum({e}) / sum({n}) * 100.0', 3)} AS corpus_rate, {d.half_even(f'avg({e} / {n} * 100.0)', 3)} AS mean_rate, {d.half_even(f'median({e} / {n} * 100.0)', 3)} AS median_rate FROM {d.t('lineitem')} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@statement
def map_sums(d):
    return f"SELECT event_type AS reason, sum({d.json_k('props')}) AS n, count(*) AS attempts FROM {d.t('events')} WHERE {d.json_k('props')} > 0 GROUP BY 1"


@statement
def throughput(d):
    s = f"max({d.seconds('ts')}) - min({d.seconds('ts')})"
    return f"SELECT user_id, count(*) AS rows, CASE WHEN {s} = 0 THEN NULL ELSE round(count(*) / (({s}) / 60.0), 9) END AS rows_per_minute FROM {d.t('events')} GROUP BY 1"


@statement
def diversity_summary(d):
    return f"SELECT role, lang, count(*) AS n, count(DISTINCT source) AS sources, min(n_chars) AS least FROM (SELECT {ROLE} AS role, lang, source, n_chars FROM {d.t('documents')}) x GROUP BY CUBE (role, lang)"


# ---- windows


@statement
def batch_layout(d):
    """Per brand: parts by size, in batches of 8; padding is the longest of a batch times its rows."""
    return f"""WITH r AS (SELECT p_brand, p_size, {d.div('row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1', '8')} AS batch FROM {d.t('part')}),
b AS (SELECT p_brand, batch, count(*) AS n, max(p_size) AS longest, sum(p_size) AS total FROM r GROUP BY 1, 2)
SELECT p_brand, count(*) AS batches, sum(longest * n) AS padded, sum(total) AS actual, round(sum(longest * n) / cast(sum(total) AS double), 6) AS ratio, sum(CASE WHEN n < 8 THEN 1 ELSE 0 END) AS partial FROM b GROUP BY 1"""


@statement
def batch_order(d):
    key = d.text("batch")
    return f"WITH b AS (SELECT p_brand, {d.div('row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1', '8')} AS batch FROM {d.t('part')}), u AS (SELECT DISTINCT p_brand, batch FROM b) SELECT p_brand, batch, row_number() OVER (PARTITION BY p_brand ORDER BY {d.sha(f'concat({chr(39)}1234:1:{chr(39)}, {key})')}) AS place FROM u"


@statement
def shard_assignment(d):
    return f"SELECT l_partkey AS item, l_returnflag AS voice, (dense_rank() OVER (PARTITION BY l_returnflag ORDER BY {d.sha(d.text('l_partkey'))}) - 1) % 4 AS worker FROM (SELECT DISTINCT l_partkey, l_returnflag FROM {d.t('lineitem')}) x"


def _curve(d) -> str:
    """A curve per event type: the mean of a day is its error rate."""
    return f"days AS (SELECT event_type, {d.day('ts')} AS day, avg(value) AS wer, max(value) AS cer, sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS empties FROM {d.t('events')} GROUP BY 1, 2), curve AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS round FROM days)"


@statement
def earliest_within_tolerance(d):
    return f"""WITH {_curve(d)}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY wer, cer, round) AS rn FROM curve), best AS (SELECT event_type, wer AS bw, cer AS bc FROM o WHERE rn = 1),
e AS (SELECT c.*, bw, bc, wer <= bw + 0.50 AND cer <= bc + 0.25 AS eligible FROM curve c JOIN best b ON c.event_type = b.event_type)
SELECT event_type, round, eligible, round = min(CASE WHEN eligible THEN round END) OVER (PARTITION BY event_type) AS selected FROM e"""


@statement
def patience_stop(d):
    """Stops when patience rounds have gone by since the last strictly new best."""
    return f"""WITH {_curve(d)}, m AS (SELECT *, min(wer) OVER (PARTITION BY event_type ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM curve),
b AS (SELECT event_type, max(round) AS last_round, max(CASE WHEN before IS NULL OR wer < before THEN round END) AS best_round FROM m GROUP BY 1)
SELECT event_type, last_round, best_round, last_round - best_round >= 3 AS stop FROM b"""


@statement
def curve_stop_reason(d):
    return f"""WITH {_curve(d)}, m AS (SELECT *, min(wer) OVER (PARTITION BY event_type ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(wer) OVER (PARTITION BY event_type) AS best, row_number() OVER (PARTITION BY event_type ORDER BY round DESC) AS back FROM curve),
b AS (SELECT event_type, count(*) AS n, max(round) AS last_round, max(CASE WHEN before IS NULL OR wer < before THEN round END) AS best_round, sum(CASE WHEN round > 1 THEN empties ELSE 0 END) AS empties, bool_and(CASE WHEN back <= 2 THEN wer > best + 5.0 ELSE true END) AS worse FROM m GROUP BY 1)
SELECT event_type, best_round, CASE WHEN n < 3 THEN 'minimum_rounds_not_reached' WHEN empties > 0 THEN 'empty_hypotheses_reappeared' WHEN worse THEN 'two_consecutive_catastrophic_wer_regressions' WHEN last_round - best_round >= 3 THEN 'three_rounds_without_new_raw_best' ELSE 'new_best_patience_active' END AS reason FROM b"""


@statement
def smallest_within_best(d):
    return f"WITH t AS (SELECT event_type, cast(user_id % 8 AS bigint) AS batch, sum(value) AS speed FROM {d.t('events')} GROUP BY 1, 2), m AS (SELECT *, max(speed) OVER (PARTITION BY event_type) AS best FROM t) SELECT event_type, min(CASE WHEN speed >= 0.95 * best THEN batch END) AS selected FROM m GROUP BY 1"


@statement
def envelope_tolerance(d):
    return f"""WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS wer, avg(p_size) AS cer FROM {d.t('part')} GROUP BY 1), u AS (SELECT model, 'wer' AS metric, wer AS v, 0.5 AS tolerance FROM m UNION ALL SELECT model, 'cer', cer, 0.25 FROM m), b AS (SELECT metric, min(v) AS best FROM u GROUP BY 1)
SELECT model, u.metric, round(v - best, 6) AS delta, v <= best + tolerance AS within FROM u JOIN b ON u.metric = b.metric"""


@statement
def prefix_preserved(d):
    """Places of the inherited rows in the union: the first n have to be equal."""
    return f"WITH a AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) AS pos FROM {d.t('nation')}), b AS (SELECT r_regionkey AS id, row_number() OVER (ORDER BY r_regionkey) AS pos FROM {d.t('region')}) SELECT b.pos, b.id AS inherited, a.id AS combined, a.id = b.id AS same FROM b FULL OUTER JOIN a ON a.pos = b.pos WHERE b.pos IS NOT NULL"


@statement
def occurrence_ids(d):
    return f"SELECT conv_id, turn, concat({d.lpad(d.text('conv_id'), 6)}, '-', {d.lpad(d.text('row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1'), 3)}) AS occurrence FROM {d.t('conversations')}"


# ---- selection


@statement
def topk_hard(d):
    score = "CASE WHEN p_size = 1 THEN 1000.0 ELSE 0.0 END + p_retailprice / 10 + 0.25 * p_size"
    return f"SELECT p_partkey, round({score}, 6) AS hard_score FROM {d.t('part')} ORDER BY {score} DESC, p_size DESC, p_retailprice DESC, {d.sha(d.text('p_partkey'))}, p_partkey LIMIT 100"


@statement
def topk_seeded_controls(d):
    anti = "LEFT ANTI JOIN" if d.spark else "ANTI JOIN"
    key = d.text("c_custkey")
    return f"SELECT c_custkey FROM {d.t('customer')} {anti} (SELECT o_custkey FROM {d.t('orders')} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey ORDER BY {d.sha(f'concat({chr(39)}17:{chr(39)}, {key})')} LIMIT 50"


@statement
def topk_per_cell(d):
    return f"SELECT doc_id, lang, rn <= 20 AS selected FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {d.sha(d.text('doc_id'))}, doc_id) AS rn FROM {d.t('documents')}) x WHERE rn <= 25"


@statement
def topk_group_cap(d):
    return f"SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {d.t('orders')} WHERE o_totalprice BETWEEN 1000 AND 300000) x WHERE rn <= 3 ORDER BY {d.sha(d.text('o_orderkey'))} LIMIT 200"


@statement
def stratified_round_robin(d):
    return f"SELECT doc_id, lang, source, rn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {d.sha(d.text('doc_id'))}, doc_id) AS rn FROM {d.t('documents')}) x ORDER BY rn, lang, source LIMIT 150"


@statement
def hash_subset(d):
    return f"SELECT doc_id, n_chars FROM {d.t('documents')} ORDER BY {d.sha(d.text('doc_id'))} LIMIT 64"


@statement
def split_by_hash_rank(d):
    h = d.sha(f"concat('corpus', {d.text('doc_id')}, coalesce(text, ''))")
    return f"SELECT lang, doc_id, rn <= floor(0.95 * n) AS training FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM {d.t('documents')}) x"


# ---- generators


@statement
def exposure_schedule(d):
    """Clean and augmented rounds for every part of a size class; voices rotate with the place."""
    voices = [f"'v{i}'" for i in range(9)]
    seed = d.sha("concat('1234:', " + d.text("round") + ", ':', " + d.text("pos") + ")")
    return f"""WITH o AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY {d.sha(d.text('p_partkey'))}, p_partkey) - 1 AS pos FROM {d.t('part')}), r AS (SELECT {d.series(1, 20)} AS round)
SELECT p_size, p_partkey, round, pos, {d.pick(voices, 'CASE WHEN round <= 9 THEN round ELSE (pos + round - 10) % 9 + 1 END')} AS voice, CASE WHEN round <= 9 THEN 'clean' ELSE 'augmented' END AS view_type, round > 9 AND (pos + round - 10) % 2 = 0 AS spec_augment, {seed} AS batch_order_seed FROM o CROSS JOIN r"""


@statement
def schedule_balance(d):
    return f"""WITH o AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY {d.sha(d.text('p_partkey'))}, p_partkey) - 1 AS pos FROM {d.t('part')}), r AS (SELECT {d.series(1, 20)} AS round),
s AS (SELECT round, p_size, p_partkey, (pos + round) % 9 AS voice FROM o CROSS JOIN r), v AS (SELECT round, voice, count(*) AS n FROM s GROUP BY 1, 2)
SELECT round, count(*) AS voices, sum(n) AS rows, max(n) - min(n) AS spread FROM v GROUP BY 1"""


@statement
def schedule_leakage(d):
    semi = "LEFT SEMI JOIN" if d.spark else "SEMI JOIN"
    return f"WITH h AS (SELECT doc_id FROM {d.t('documents')} WHERE doc_id % 10 = 0) SELECT count(*) AS leaked FROM {d.t('labels')} {semi} h USING (doc_id)"


@statement
def seeds_and_units(d):
    k = d.text("p_partkey")
    key = f"concat({k}, ':', p_brand)"
    voice = d.pick([f"'voice{i}'" for i in range(9)], f"{d.hex(key, 8)} % 9 + 1")
    return f"SELECT p_partkey, {d.hex(key, 12)} / cast(281474976710655 AS double) AS unit, {d.hex(key, 12)} % 2147483647 AS seed, {d.hex(key, 8)} AS batch_seed, {voice} AS voice FROM {d.t('part')}"


@statement
def refill_plan(d):
    return f"""WITH n AS (SELECT lang, source, count(*) AS have, count(l.doc_id) AS kept FROM {d.t('documents')} x LEFT JOIN {d.t('labels')} l ON x.doc_id = l.doc_id GROUP BY 1, 2),
f AS (SELECT lang, source, kept, greatest(0, 60 - kept) AS deficit, kept / cast(have AS double) * 40 AS yield_ FROM n)
SELECT lang, source, deficit, least(5, greatest(1, cast(ceil(deficit / 40.0) AS bigint))) AS attempts, CASE WHEN deficit = 0 THEN 0 ELSE cast(ceil(deficit / greatest(8.0, 0.75 * yield_)) AS bigint) + 5 END AS tasks FROM f"""


@statement
def task_grid(d):
    key = d.text("shard")
    return f"WITH c AS (SELECT DISTINCT lang FROM {d.t('documents')}), s AS (SELECT {d.series(0, 8)} AS shard) SELECT lang AS cell_id, shard, {d.hex(f'concat({chr(39)}ns:{chr(39)}, lang, {chr(39)}:{chr(39)}, {key})', 12)} % 2147483647 AS seed, (row_number() OVER (ORDER BY lang, shard) - 1) % 2 AS worker FROM c CROSS JOIN s"


# ---- decisions


def _models(d) -> str:
    """Models are brands and splits are two part sizes classes, each with rates and empties; one brand is the base."""
    return f"m AS (SELECT p_brand AS model, CASE WHEN p_size % 2 = 0 THEN 'fleurs_v2' ELSE 'artur_j' END AS split, avg(p_retailprice) / 20 AS wer, avg(p_size) AS cer, sum(CASE WHEN p_size = 1 THEN 1 ELSE 0 END) AS empty_ FROM {d.t('part')} GROUP BY 1, 2), base AS (SELECT * FROM m WHERE model = (SELECT min(p_brand) FROM {d.t('part')})), j AS (SELECT m.model, m.split, m.wer - b.wer AS dw, m.cer - b.cer AS dc, m.empty_ - b.empty_ AS de FROM m JOIN base b ON m.split = b.split)"


@statement
def burden_by_model(d):
    return f"WITH {_models(d)} SELECT model, round(sum(greatest(0.0, dw) + greatest(0.0, dc)), 6) AS burden FROM j GROUP BY model"


@statement
def gate_flags(d):
    return f"WITH {_models(d)} SELECT model, bool_and(dw <= 1.0 AND dc <= 1.5 AND de <= 0) AS non_regression, bool_or(dw <= -1.0 OR dc <= -1.5) AS improvement, bool_or(dw < 0 OR dc < 0) AS gain FROM j GROUP BY model"


@statement
def decision_labels(d):
    return f"""WITH {_models(d)}, g AS (SELECT model, bool_and(dw <= 1.0 AND dc <= 1.5 AND de <= 0) AS safe, bool_or(dw <= -1.0 OR dc <= -1.5) AS better, bool_or(dw < 0 OR dc < 0) AS gain, sum(greatest(0.0, dw) + greatest(0.0, dc)) AS burden FROM j GROUP BY model), w AS (SELECT max(burden) AS worst FROM g)
SELECT model, CASE WHEN safe AND better AND gain THEN 'CHANGES_CONCLUSION_POSITIVELY' WHEN NOT gain OR coalesce((worst - burden) / nullif(worst, 0) * 100, 0) < 20 THEN 'CHANGES_CONCLUSION_NEGATIVELY' WHEN NOT safe THEN 'CONFIRMS_CONCLUSION' ELSE 'INCONCLUSIVE' END AS label FROM g CROSS JOIN w"""


@statement
def promotion_reasons(d):
    said = d.labels(("synthetic gain too small", "dw > -0.5 AND dc > -0.5"), ("wer regressed", "dw > 1.0"), ("cer regressed", "dc > 1.5"), ("empties increased", "de > 0"))
    return f"WITH {_models(d)} SELECT model, split, {said} AS reasons, dw <= -0.5 AND dw <= 1.0 AND dc <= 1.5 AND de <= 0 AS promoted FROM j"


@statement
def metric_pivot(d):
    return f"WITH {_models(d)} SELECT model, round(max(CASE WHEN split = 'fleurs_v2' THEN wer END), 6) AS fleurs_wer, round(max(CASE WHEN split = 'artur_j' THEN wer END), 6) AS artur_wer, sum(empty_) AS empties FROM m GROUP BY model"


# ---- segments


@statement
def segments_validate(d):
    """Events of a user as intervals up to the next event."""
    return f"WITH s AS (SELECT user_id, event_id, {d.seconds('ts')} AS a, lead({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {d.t('events')}) SELECT user_id, count(*) AS segments, sum(CASE WHEN b <= a THEN 1 ELSE 0 END) AS empty_, max(b - a) AS longest FROM s WHERE b IS NOT NULL GROUP BY 1"


@statement
def segments_capped(d):
    return f"WITH s AS (SELECT user_id, event_id, ts, lead({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) - {d.seconds('ts')} AS n FROM {d.t('events')}) SELECT user_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_id) AS rn FROM s WHERE n BETWEEN 60 AND 100000) x WHERE rn <= 2"


# ---- event time and other relational extensions


@statement
def x_events_tumbling(d):
    return f"SELECT {d.floor_to('ts', 3600)} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {d.t('events')} GROUP BY 1, 2"


@statement
def x_events_session(d):
    return f"""WITH g AS (SELECT user_id, {d.seconds('ts')} AS s, value, CASE WHEN {d.seconds('ts')} - lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS new_ , event_id FROM {d.t('events')}),
k AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session, count(*) AS n, min(s) AS starts, max(s) AS ends FROM k GROUP BY 1, 2"""


@statement
def x_rolling_mean(d):
    return f"SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM {d.t('events')}"


@statement
def x_asof(d):
    """Each purchase with the latest view before it: a running value instead of a range join."""
    return f"SELECT event_id, user_id, seen FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END {'IGNORE NULLS' if not d.spark else ', true'}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {d.t('events')}) x WHERE event_type = 'purchase'"


@statement
def x_rollup(d):
    return f"SELECT n_name, c_mktsegment, count(*) AS orders, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents FROM {d.t('orders')} JOIN {d.t('customer')} ON o_custkey = c_custkey JOIN {d.t('nation')} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)"


# ---- further guards and summaries


@statement
def leak_number_masked(d):
    """Documents whose text with numbers masked equals a protected text's; only digits are masked here, as punctuation is gone from the surface form."""
    mask = (lambda x: f"regexp_replace({x}, '(^| )[0-9]+(?= |$)', '$1<NUM>')") if d.spark else (lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '<NUM>' ELSE w END), ' ')")
    return f"WITH {_docs(d)}, b AS (SELECT DISTINCT {d.sha(mask(d.surface('text')))} AS h FROM {d.t('benchmark')}) SELECT doc_id AS candidate_id, role AS partition_role, 'protected_number_masked_overlap' AS code, 'review_required' AS severity FROM docs JOIN b ON {d.sha(mask('s'))} = b.h"


@statement
def compare_predictions(d):
    """Two prediction sets against each other: unequal raw and normalised texts by role."""
    n, m = d.surface("text"), d.surface("before_")
    return f"""WITH p AS (SELECT role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_ FROM {d.t('conversations')})
SELECT role, count(*) AS n, sum(CASE WHEN text <> before_ THEN 1 ELSE 0 END) AS raw_mismatches, sum(CASE WHEN {n} <> {m} THEN 1 ELSE 0 END) AS normalized_mismatches FROM p WHERE before_ IS NOT NULL GROUP BY role"""


@statement
def hardvoice_schedule(d):
    """Four of twenty rounds are replaced by another source, whose profile rotates with the place."""
    return f"WITH o AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM {d.t('part')}), r AS (SELECT {d.series(1, 20)} AS round) SELECT round, CASE WHEN round IN (5, 10, 15, 20) THEN concat('s6-', {d.text('(3 * pos + round) % 11')}) ELSE 'inherited' END AS view_, count(*) AS n FROM o CROSS JOIN r GROUP BY 1, 2"


@statement
def edit_count_totals(d):
    return f"SELECT l_linestatus, sum(cast(l_linenumber AS bigint)) AS substitutions, sum(cast(l_quantity AS bigint)) AS deletions, sum(l_suppkey % 7) AS insertions, sum(cast(l_linenumber AS bigint) + cast(l_quantity AS bigint) + l_suppkey % 7) AS total FROM {d.t('lineitem')} GROUP BY 1"


@statement
def augmented_duplicate_groups(d):
    """Groups of one hash, explained by one key, by one known set of keys, or not at all."""
    return f"""WITH {_docs(d)}, g AS (SELECT h, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM fp GROUP BY h HAVING count(*) > 1)
SELECT CASE WHEN sources = 1 THEN 'same_key' WHEN langs = 1 THEN 'same_profile' ELSE 'unexplained' END AS kind, count(*) AS groups_, sum(n - 1) AS extras FROM g GROUP BY 1"""


@statement
def collection_audit(d):
    """One pass over a collection by role: repeats, protected overlaps, and the most used opening."""
    first = "array_join(slice(split(s, ' '), 1, 2), ' ')" if d.spark else "array_to_string(string_split(s, ' ')[1:2], ' ')"
    return f"""WITH {_docs(d)}, b AS (SELECT DISTINCT {d.sha(d.surface('text'))} AS h FROM {d.t('benchmark')}),
o AS (SELECT role, {first} AS opening, count(*) AS n FROM docs GROUP BY 1, 2), m AS (SELECT role, max(n) AS most FROM o GROUP BY 1)
SELECT fp.role AS partition_role, count(*) AS rows, count(*) - count(DISTINCT fp.h) AS repeats, count(b.h) AS protected_overlaps, max(most) AS largest_opening FROM fp LEFT JOIN b ON fp.h = b.h JOIN m ON fp.role = m.role GROUP BY fp.role"""


@statement
def token_lengths(d):
    n = "size(filter(split(s, ' '), w -> w <> ''))" if d.spark else "len(list_filter(string_split(s, ' '), lambda w: w <> ''))"
    return f"WITH {_docs(d)} SELECT role AS split, sum({n}) AS tokens, min({n}) AS least, max({n}) AS most, sum(CASE WHEN {n} = 0 THEN 1 ELSE 0 END) AS empties FROM docs GROUP BY 1"


@statement
def failure_brief(d):
    """Tags of failures, with the first sixteen empties."""
    return f"WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM {d.t('documents')} WHERE n_chars < 600) SELECT source, doc_id, n FROM f WHERE rn <= 16"


@statement
def retired_documents(d):
    semi = "LEFT SEMI JOIN" if d.spark else "SEMI JOIN"
    return f"WITH a AS (SELECT doc_id, {d.sha('text')} AS h FROM {d.t('documents')}), r AS (SELECT {d.sha('text')} AS h FROM {d.t('documents')} x JOIN {d.t('labels')} l ON x.doc_id = l.doc_id WHERE toxic = 1) SELECT doc_id FROM a {semi} r ON a.h = r.h"


@statement
def protected_index(d):
    """A gate's distinct surface hashes, with its row count."""
    return f"WITH h AS (SELECT {d.sha(d.surface('text'))} AS h FROM {d.t('benchmark')}) SELECT h AS surface_hash, count(*) AS rows FROM h GROUP BY 1"


@statement
def index_guard(d):
    """Ids have to be exactly 0 to n - 1."""
    return f"SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, min(doc_id) AS least, max(doc_id) AS most, count(DISTINCT doc_id) = count(*) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AS whole FROM {d.t('documents')}"


@statement
def epoch_coverage(d):
    """Each order line's place among its order has to occur once, from 1 on."""
    return f"SELECT l_orderkey FROM {d.t('lineitem')} GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) <> count(*)"


def _query(make: Callable[[SimpleNamespace], str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(make(_spark(spark, sf_dir)))


QUERIES = {name: (_query(make), make(DUCK)) for name, make in STATEMENTS.items()}
