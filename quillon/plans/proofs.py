"""Queries of guards and proofs over the driver's tables; the DuckDB statements follow the definitions, apart from the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proofs as p
from ..sources.tables import table
from .texts import parse_lines


def review_scan(spark, sf_dir):
    """Reviews by labels under 400 ids; an outcome is ACCEPT, REJECT or something that no review may say."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    said = F.when(F.col("t") == 1, "REJECT").when(F.col("q") == 1, "ACCEPT").when(F.col("doc_id") % 7 == 0, "later")
    reviews = l.select("doc_id", (F.col("doc_id") % 400).alias("review_id"), said.alias("outcome"))
    found = p.review_issues(reviews, "review_id", "outcome", ("ACCEPT", "REJECT"), "doc_id")
    return found.select("doc_id", "review_id", F.array_join("issues", ",").alias("issues"))


REVIEW_SCAN = """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id)
SELECT doc_id, doc_id % 400 AS review_id, concat_ws(',', CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY doc_id % 400) THEN 'duplicate_id' END, CASE WHEN NOT (coalesce(t, 0) = 1 OR coalesce(q, 0) = 1) THEN 'bad_outcome' END) AS issues FROM l"""


def manifest_issues(spark, sf_dir):
    """Orders as texts against their first lines as audio: missing sides, another day, repeated paths."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 23 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("voice"))
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_orderkey % 19 <> 0")
    l = l.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 29 == 0, 9).otherwise(F.col("l_orderkey") % 5).alias("voice"), F.concat_ws("/", F.col("l_partkey") % 997, "l_suppkey", "l_quantity").alias("path"))
    return p.one_to_one_issues(o, l, "id", ("voice",), ("path",)).select("id", F.array_join("issues", ",").alias("issues"))


MANIFEST_ISSUES = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS voice FROM orders WHERE o_orderkey % 23 <> 0),
l AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 29 = 0 THEN 9 ELSE l_orderkey % 5 END AS voice, (l_partkey % 997, l_suppkey, l_quantity) AS path FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 19 <> 0),
m AS (SELECT *, count(*) OVER (PARTITION BY path) > 1 AS again FROM l)
SELECT coalesce(o.id, m.id) AS id, concat_ws(',', CASE WHEN o.id IS NULL THEN 'missing_left' END, CASE WHEN m.id IS NULL THEN 'missing_right' END, CASE WHEN o.voice <> m.voice THEN 'voice_differs' END, CASE WHEN again THEN 'path_repeated' END, CASE WHEN count(*) OVER (PARTITION BY coalesce(o.id, m.id)) > 1 THEN 'id_repeated' END) AS issues FROM o FULL JOIN m ON o.id = m.id"""


def heldout_audio(spark, sf_dir):
    """Audio rows by voice joined to texts: rows, those without a text, those of a forbidden voice, and whether the expected number is met."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") * 3).alias("c_custkey"))
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("__text"))
    joined = e.join(texts, "c_custkey", "left")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    out = joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), n(F.col("__text").isNull()).alias("unmatched"), n(F.col("event_type") == "error").alias("forbidden"))
    return out.withColumn("status", F.when((F.col("forbidden") == 0) & (F.col("unmatched") == 0) & (F.col("rows") > 0), "PASSED").otherwise("BLOCKED"))


HELDOUT_AUDIO = """SELECT *, CASE WHEN forbidden = 0 AND unmatched = 0 THEN 'PASSED' ELSE 'BLOCKED' END AS status FROM (SELECT event_type, count(*) AS rows, count(*) FILTER (user_id * 3 NOT IN (SELECT c_custkey FROM customer)) AS unmatched, count(*) FILTER (event_type = 'error') AS forbidden FROM events GROUP BY 1)"""


def epoch_coverage_check(spark, sf_dir):
    """Five epochs schedule customers' orders; how far the slice of each covers the customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).where("key % 41 <> 0")
    out = None
    for epoch in range(5):
        one = p.coverage(o.where(F.col("o_orderkey") % 5 == epoch).select(F.col("o_custkey").alias("key")), c, "key").withColumn("epoch", F.lit(epoch))
        out = one if out is None else out.unionAll(one)
    return out


EPOCH_COVERAGE_CHECK = """WITH e AS (SELECT unnest(range(0, 5))::INT AS epoch), k AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 41 <> 0), s AS (SELECT (o_orderkey % 5)::INT AS epoch, o_custkey AS key, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT epoch, coalesce((SELECT sum(n) FROM s WHERE s.epoch = e.epoch), 0)::BIGINT AS scheduled, (SELECT count(*) FROM s WHERE s.epoch = e.epoch AND key IN (SELECT key FROM k)) AS covered,
(SELECT count(*) FROM k WHERE key NOT IN (SELECT key FROM s WHERE s.epoch = e.epoch)) AS unscheduled, (SELECT count(*) FROM s WHERE s.epoch = e.epoch AND key NOT IN (SELECT key FROM k)) AS unknown, (SELECT count(*) FROM s WHERE s.epoch = e.epoch AND n > 1) AS repeated FROM e"""


def dev_partition_proof(spark, sf_dir):
    """Eligible holdout documents, 30 a source by hash, and their overlap with the others by five keys."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    chosen = p.global_rank(d.where("doc_id % 10 = 0 and n_chars between 200 and 4000"), "source", F.sha2(F.concat_ws(":", F.lit("41"), "doc_id"), 256), name="__pos")
    starts = chosen.groupBy("source").agg(F.min("__pos").alias("__start"))
    chosen = chosen.join(starts, "source").where("__pos - __start < 30").select(*d.columns)
    keys = {"id": F.col("doc_id"), "text": F.sha2("text", 256), "opening": F.substring("text", 1, 12), "cell": F.concat_ws("/", "lang", "source"), "template": F.when(F.col("doc_id") % 20 == 0, "").otherwise(F.col("n_chars").cast("string"))}
    return p.overlap_proof(chosen, d.where("doc_id % 10 <> 0"), keys)


_DEV_KEYS = "unnest(['id', 'text', 'opening', 'cell', 'template']) AS key_name, unnest([doc_id::VARCHAR, coalesce(text, ''), substr(coalesce(text, ''), 1, 12), concat_ws('/', lang, source), CASE WHEN doc_id % 20 = 0 THEN '' ELSE n_chars::VARCHAR END]) AS value"
DEV_PARTITION_PROOF = f"""WITH h AS (SELECT * FROM documents WHERE doc_id % 10 = 0 AND n_chars BETWEEN 200 AND 4000 QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('41:' || doc_id)) <= 30),
a AS (SELECT DISTINCT * FROM (SELECT {_DEV_KEYS} FROM h) WHERE key_name = 'text' OR trim(value) <> ''), b AS (SELECT DISTINCT * FROM (SELECT {_DEV_KEYS} FROM documents WHERE doc_id % 10 <> 0) WHERE key_name = 'text' OR trim(value) <> '')
SELECT key_name, count(*) FILTER (l) AS "left", count(*) FILTER (r) AS "right", count(*) FILTER (l AND r) AS shared FROM (SELECT coalesce(a.key_name, b.key_name) AS key_name, a.value IS NOT NULL AS l, b.value IS NOT NULL AS r FROM a FULL JOIN b ON a.key_name = b.key_name AND a.value = b.value) GROUP BY key_name"""


def selected_rounds(spark, sf_dir):
    """Rounds of each supplier with the one that was selected: its smallest error, the earliest of equal ones; suppliers of one nation have none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), "s_nationkey")
    rounds = s.select("run", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("round")).withColumn("error", (F.col("run") * 7 + F.col("round") * F.col("round") * 5) % 11)
    chosen = rounds.where("s_nationkey <> 3").groupBy("run").agg(F.min_by("round", F.struct("error", "round")).alias("round"))
    return p.marked(rounds.select("run", "round", "error"), "run", chosen)


SELECTED_ROUNDS = """WITH r AS (SELECT s_suppkey AS run, s_nationkey, unnest(range(0, 6))::INT AS round FROM supplier), e AS (SELECT *, (run * 7 + round * round * 5) % 11 AS error FROM r)
SELECT run, round, error, s_nationkey <> 3 AND row_number() OVER (PARTITION BY run ORDER BY error, round) = 1 AS selected FROM e"""


def guidance_items(spark, sf_dir):
    """Lines of conversations' turns as guidance: trimmed, without blank ones, with those that name a person or a reference refused."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.]")).alias("pos", "item"))
    return p.guidance(c, "item", "[0-9]|[A-Z]").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "item", "refused")


GUIDANCE_ITEMS = "SELECT conv_id, turn, pos, trim(item, ' ') AS item, regexp_matches(item, '[0-9]|[A-Z]') AS refused FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), '.')) AS item, generate_subscripts(string_split(coalesce(text, ''), '.'), 1) - 1 AS pos FROM conversations) WHERE trim(item, ' ') <> ''"


def safe_arms(spark, sf_dir):
    """Arms with nested metrics and paths, as JSON of the allowed fields alone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("name"), F.struct(F.col("o_custkey").alias("rows"), F.col("o_orderpriority").alias("text")).alias("metrics"), F.struct(F.lit("/home/x").alias("path")).alias("private")).alias("arm"))
    kept = p.allowed_only(o, "arm", ["name", "metrics.rows", "metrics.absent"])
    return kept.select("o_orderkey", F.to_json("arm").alias("arm"))


SAFE_ARMS = """SELECT o_orderkey, '{"name":"' || o_orderstatus || '","metrics":{"rows":' || o_custkey || '}}' AS arm FROM orders"""


def nested_losses(spark, sf_dir):
    """Losses out of nested reports, with defaults for what is missing or no number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("final"), F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.col("o_orderkey").cast("string")).alias("step")).alias("loss"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))).alias("report"))
    return o.select("o_orderkey", *p.nested("report", {"final": ("$.loss.final", "bigint", -1), "step": ("$.loss.step", "bigint", 0), "status": ("$.status", "string", "unknown")}))


NESTED_LOSSES = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE -1 END AS final, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey END AS step, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'unknown' END AS status FROM orders"


def enriched_comparison(spark, sf_dir):
    """Baseline and candidate predictions beside the record: which changed, which are right, and whether the row may be compared."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("reference"), "p_size")
    base = a.where("p_partkey % 13 <> 0").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lower("reference")).otherwise(F.col("reference")).alias("baseline"))
    cand = a.where("p_partkey % 17 <> 0").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("reference")).alias("candidate"))
    both = a.join(base, "p_partkey", "left").join(cand, "p_partkey", "left")
    eligible = F.col("baseline").isNotNull() & F.col("candidate").isNotNull() & (F.col("p_size") >= 5)
    same = lambda f: F.coalesce(f(F.col("baseline")) != f(F.col("candidate")), F.lit(False))
    return both.select("p_partkey", eligible.alias("eligible"), same(lambda c: c).alias("changed"), same(F.lower).alias("changed_normalised"), F.coalesce(F.col("candidate") == "", F.lit(False)).alias("empty"))


ENRICHED_COMPARISON = """WITH a AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_size % 3 = 0 THEN lower(p_brand) ELSE p_brand END END AS b, CASE WHEN p_partkey % 17 <> 0 THEN CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END END AS c FROM part)
SELECT p_partkey, b IS NOT NULL AND c IS NOT NULL AND p_size >= 5 AS eligible, coalesce(b <> c, false) AS changed, coalesce(lower(b) <> lower(c), false) AS changed_normalised, coalesce(c = '', false) AS empty FROM a"""


def generation_outcomes(spark, sf_dir):
    """Raw outputs (turns under a heading, with a list mark and a fence in some) as records and rejections, counted by reason."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("task"), F.concat(F.lit("Output:\n- one\n"), F.when(F.col("turn") % 2 == 0, "```\ncode\n```\n").otherwise(""), F.lit("{x}\n\n2. two")).alias("raw"))
    lines = parse_lines(c, "task", "raw")
    return lines.groupBy(F.coalesce("reason", F.lit("record")).alias("outcome"), F.coalesce("line", F.lit("")).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"))


GENERATION_OUTCOMES = """WITH c AS (SELECT count(*) AS n, count(*) FILTER (turn % 2 = 0) AS f, count(DISTINCT conv_id * 1000 + turn) AS t, count(DISTINCT conv_id * 1000 + turn) FILTER (turn % 2 = 0) AS ft FROM conversations)
SELECT outcome, line, n, t AS tasks FROM c, (VALUES ('parser_heading', ''), ('record', 'one'), ('record', 'two'), ('parser_json_or_markup', '')) v(outcome, line)
UNION ALL SELECT 'parser_markdown_fence', '', 2 * f, ft FROM c UNION ALL SELECT 'parser_markdown_content', '', f, ft FROM c"""


def _merged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cell"), F.concat_ws(":", "o_custkey", "o_orderpriority").alias("form"))
    workers = [o.where(F.col("id") % 4 == k) for k in (1, 2)]
    return p.merged_texts(workers, o.where("id % 4 = 0 and id < 2000"), "id", "cell", "form", 1000)


def merged_texts(spark, sf_dir):
    """Two workers' orders after inherited ones, 1,000 of each priority."""
    return _merged(spark, sf_dir)[0]


def short_cells(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


_MERGED = """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS cell, (o_custkey, o_orderpriority) AS form FROM orders), old AS (SELECT * FROM o WHERE id % 4 = 0 AND id < 2000),
fresh AS (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY id) AS i FROM (SELECT * FROM o WHERE id % 4 IN (1, 2) QUALIFY id = min(id) OVER (PARTITION BY form)) WHERE form NOT IN (SELECT form FROM old))"""
MERGED_TEXTS = f"{_MERGED} SELECT id, cell, part, row_number() OVER (ORDER BY part, id) - 1 AS position FROM (SELECT id, cell, 0 AS part FROM old UNION ALL SELECT id, cell, 1 FROM fresh WHERE i <= 1000)"
SHORT_CELLS = f"{_MERGED} SELECT cell, 1000 - coalesce(n, 0) AS deficit FROM (SELECT DISTINCT cell FROM o WHERE id % 4 IN (1, 2) OR (id % 4 = 0 AND id < 2000)) LEFT JOIN (SELECT cell, count(*) AS n FROM fresh GROUP BY cell) USING (cell) WHERE coalesce(n, 0) < 1000"

_ALL = (review_scan, manifest_issues, heldout_audio, epoch_coverage_check, dev_partition_proof, selected_rounds, guidance_items, safe_arms, nested_losses, enriched_comparison, generation_outcomes, merged_texts, short_cells)
QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in _ALL}
