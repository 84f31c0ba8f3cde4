"""Queries of the composite operators over the driver's tables; the DuckDB statements follow the definitions, apart from the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import text as t
from ..operators import composites as c
from ..operators import contracts
from ..operators.ranks import global_rank
from ..sources.tables import records, role, table
from . import duck, forms


def partition_issues(spark, sf_dir):
    """Broken records with their ordinal among rows that aren't blank; every thirteenth row stands for a blank line."""
    found = c.numbered_issues(forms._records(spark, sf_dir), F.col("doc_id") % 13 == 0, contracts.text_record("synthetic_candidate"), "doc_id")
    return found.select("doc_id", "ordinal", "reason")


PARTITION_ISSUES = f"SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal, reason FROM ({forms.RECORD_CONTRACT}) WHERE doc_id % 13 <> 0) WHERE reason IS NOT NULL"


def grouped_roles(spark, sf_dir):
    r = records(spark, sf_dir).select("partition_role", "candidate_id")
    return global_rank(r, "partition_role", "candidate_id", name="position")


GROUPED_ROLES = f"SELECT {duck.role()} AS partition_role, doc_id AS candidate_id, row_number() OVER (ORDER BY {duck.role()}, doc_id) - 1 AS position FROM documents"


def minimal_pair_groups(spark, sf_dir):
    """Groups of three neighbours; reviews are labels, approving what is good and not toxic; every eleventh row is in no pair."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 3).alias("pair_group"))
    reviews = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.every((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"))
    family = F.when(F.col("doc_id") % 11 != 0, F.col("lang"))
    return c.approved_groups(d.join(reviews, "doc_id", "left"), "pair_group", family, F.when(F.col("doc_id") % 10 == 0, "holdout").otherwise("other"), F.col("accepted"), 3)


MINIMAL_PAIR_GROUPS = """WITH v AS (SELECT doc_id, bool_and(quality = 1 AND toxic = 0) AS ok FROM labels GROUP BY doc_id)
SELECT doc_id // 3 AS pair_group, count(*) AS rows, count(*) <= 3 AND count(*) FILTER (doc_id % 11 = 0 OR lang IS NULL OR ok IS NOT TRUE) = 0 AND count(DISTINCT lang) = 1 AND count(DISTINCT doc_id % 10 = 0) = 1 AS approved
FROM documents LEFT JOIN v USING (doc_id) GROUP BY 1"""


def expanded_decisions(spark, sf_dir):
    """One decision for a whole file, blocked unless its rows are as many as expected, and the reviews of the holdout below it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    n = items.count()
    whole = c.whole_file(items, "id", "ACCEPT", n).select("id", F.lit("whole").alias("part"), "outcome")
    other = c.whole_file(docs, "id", "ACCEPT", -1).select("id", F.lit("other").alias("part"), "outcome")
    held = table(spark, sf_dir, "labels").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.lit("holdout").alias("part"), F.when(F.col("toxic") == 1, "REJECT").otherwise("ACCEPT").alias("outcome"))
    return whole.unionByName(other).unionByName(held)


EXPANDED_DECISIONS = "SELECT item_id AS id, 'whole' AS part, 'ACCEPT' AS outcome FROM benchmark UNION ALL SELECT doc_id, 'other', 'BLOCKED' FROM documents UNION ALL SELECT doc_id, 'holdout', CASE WHEN toxic = 1 THEN 'REJECT' ELSE 'ACCEPT' END FROM labels WHERE doc_id % 10 = 0"


def split_predictions(spark, sf_dir):
    """Predictions for all documents but some, and for some that don't exist, by split."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))
    said = d.where("doc_id % 17 <> 0").select("doc_id").unionAll(d.where("doc_id % 31 = 0").select(-F.col("doc_id") - 1))
    return c.split_matches(d, said, "doc_id", "split")


SPLIT_PREDICTIONS = """SELECT lang AS split, count(*) FILTER (doc_id % 17 <> 0) AS matched, count(*) FILTER (doc_id % 17 = 0) AS missing, 0 AS unexpected, false AS exact FROM documents GROUP BY lang
UNION ALL SELECT NULL, 0, 0, count(*), false FROM documents WHERE doc_id % 31 = 0"""


def public_summary(spark, sf_dir):
    """Audio and wall seconds of each kind with real-time factor, its inverse and rows a second; null where nothing was measured."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 50).alias("shard"), "value")
    s = e.groupBy("event_type", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor("value")).alias("audio"), F.sum(F.when(F.col("shard") % 5 != 0, F.floor(F.col("value") / 4)).otherwise(0)).alias("wall"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return s.select("event_type", "shard", "rows", "audio", "wall", ratio("wall", "audio").alias("rtf"), ratio("audio", "wall").alias("inverse"), ratio("rows", "wall").alias("per_second"))


PUBLIC_SUMMARY = """WITH s AS (SELECT event_type, user_id % 50 AS shard, count(*) AS rows, sum(floor(value))::BIGINT AS audio, sum(CASE WHEN user_id % 50 % 5 <> 0 THEN floor(value / 4) ELSE 0 END)::BIGINT AS wall FROM events GROUP BY 1, 2)
SELECT *, round(wall / nullif(audio, 0), 6) AS rtf, round(audio / nullif(wall, 0), 6) AS inverse, round(rows / nullif(wall, 0), 6) AS per_second FROM s"""


def metric_histograms(spark, sf_dir):
    """Three histograms of the rows in one pass: two error rates and a duration."""
    rate = F.col("l_discount") * 1200
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), b.alias("bucket")) for n, b in (("wer", m.error_bucket(rate)), ("cer", m.error_bucket(F.col("l_quantity") - 1)), ("duration", m.duration_bucket(F.col("l_linenumber"))))))
    return table(spark, sf_dir, "lineitem").select(F.inline(cells)).groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _bucket(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN '0' WHEN {v} <= 25 THEN '0-25' WHEN {v} <= 50 THEN '25-50' WHEN {v} <= 75 THEN '50-75' WHEN {v} <= 100 THEN '75-100' ELSE 'over-100' END"


METRIC_HISTOGRAMS = f"""SELECT 'wer' AS metric, {_bucket('l_discount * 1200')} AS bucket, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'cer', {_bucket('l_quantity - 1')}, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'duration', CASE WHEN l_linenumber < 2 THEN 'short_lt_2s' WHEN l_linenumber <= 5 THEN 'medium_2_to_5s' ELSE 'long_gt_5s' END, count(*) FROM lineitem GROUP BY 2"""


def selection_ranks(spark, sf_dir):
    """The 60 dearest parts as hard rows and 40 by hash as controls, with ranks and ids."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    hard = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    by_hash = F.sha2(F.concat(F.lit("1234:"), F.col("p_partkey").cast("string")), 256)
    rest = p.join(F.broadcast(hard.select("p_partkey")), "p_partkey", "left_anti").orderBy(by_hash).limit(40)  # 60 rows
    both = hard.withColumn("reason", F.lit("hard")).unionByName(rest.withColumn("reason", F.lit("control")))
    order = F.when(F.col("reason") == "hard", -F.col("p_retailprice"))
    return c.selection_ids(both, "reason", "hard", order, F.when(F.col("reason") != "hard", by_hash), "p_partkey").select("p_partkey", "reason", "rank", "selection_id")


SELECTION_RANKS = """WITH h AS (SELECT p_partkey, 'hard' AS reason, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part QUALIFY i <= 60),
k AS (SELECT p_partkey, 'control' AS reason, row_number() OVER (ORDER BY sha256('1234:' || p_partkey)) AS i FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM h) QUALIFY i <= 40)
SELECT p_partkey, reason, i AS rank, reason || '-' || lpad(i::VARCHAR, 3, '0') AS selection_id FROM h UNION ALL SELECT p_partkey, reason, i + (SELECT count(*) FROM h), reason || '-' || lpad(i::VARCHAR, 3, '0') FROM k"""


def holdout_ledger(spark, sf_dir):
    """Every document's decision for a holdout: duplicate form, opening of a protected item, opening with figures masked, then 20 a cell by hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("cell"), t.surface_form(t.composed(F.coalesce("text", F.lit("")))).alias("form"))
    items = table(spark, sf_dir, "benchmark").select(t.surface_form(t.composed(F.coalesce("text", F.lit("")))).alias("form"))
    # no document here is a whole protected text, so the first word, and the masked form's first four characters, stand for whole forms
    opening = lambda x: F.array_join(F.slice(t.tokens(x), 1, 1), " ")
    surface = items.select(opening(F.col("form")).alias("key")).distinct().withColumn("surface", F.lit(True))
    number = items.select(F.substring(t.masked(F.col("form")), 1, 4).alias("key4")).distinct().withColumn("number", F.lit(True))
    d = d.withColumns({"key": opening(F.col("form")), "key4": F.substring(t.masked(F.col("form")), 1, 4)}).join(surface, "key", "left").join(number, "key4", "left")
    reason = F.coalesce(F.when(F.col("surface"), "protected_surface"), F.when(F.col("number"), "protected_number"))
    return c.ledger(d, "doc_id", F.col("form"), reason, "cell", 20, "1234")


HOLDOUT_LEDGER = f"""WITH d AS (SELECT doc_id, concat_ws('/', lang, source) AS cell, {duck.surface("coalesce(text, '')")} AS s FROM documents), b AS (SELECT {duck.surface("coalesce(text, '')")} AS s FROM benchmark),
j AS (SELECT doc_id, cell, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY s) THEN 'duplicate' WHEN string_split(s, ' ')[1] IN (SELECT string_split(s, ' ')[1] FROM b) THEN 'protected_surface' WHEN substr({duck.masked('s')}, 1, 4) IN (SELECT substr({duck.masked('s')}, 1, 4) FROM b) THEN 'protected_number' END AS r FROM d),
k AS (SELECT doc_id, cell, row_number() OVER (PARTITION BY cell ORDER BY sha256('1234:' || doc_id)) AS i, count(*) OVER (PARTITION BY cell) AS n FROM j WHERE r IS NULL)
SELECT doc_id, cell, r AS decision, false AS short FROM j WHERE r IS NOT NULL UNION ALL SELECT doc_id, cell, CASE WHEN i <= 20 THEN 'selected' ELSE 'overflow' END, n < 20 FROM k"""


def worker_shards(spark, sf_dir):
    """Orders of two workers in shards by customer; a shard counts once every order of it is finished or older ones are pending."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("shard"), "o_orderstatus")
    whole = c.complete_shards([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")], "shard", F.col("o_orderkey") % 311 != 0)
    return whole.groupBy("worker", "shard").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"))


WORKER_SHARDS = "SELECT (o_orderkey % 2)::INT AS worker, o_custkey % 200 AS shard, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1, 2 HAVING bool_and(o_orderkey % 311 <> 0)"


def merged_banks(spark, sf_dir):
    """Two workers' audio rows: rows, seconds and repeated keys by voice."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("voice"), "l_orderkey", F.col("l_quantity").cast("double").alias("seconds"))
    return c.merged_manifests([l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 2 = 1")], ["l_partkey", "voice"], "seconds", "voice")


MERGED_BANKS = "WITH k AS (SELECT l_partkey, l_returnflag AS voice, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT voice, sum(n)::BIGINT AS rows, round(sum(s), 4)::DOUBLE AS seconds, count(*) FILTER (n > 1) AS repeated FROM k GROUP BY voice"


def probe_rotation(spark, sf_dir):
    """For each part the rows of the voice whose turn it is."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("voice"), "l_orderkey", "l_linenumber")
    return c.rotating_choice(l, "key", "voice", ["A", "N", "R"]).select("key", "voice", "pos", "l_orderkey", "l_linenumber")


PROBE_ROTATION = "WITH k AS (SELECT l_partkey AS key, row_number() OVER (ORDER BY l_partkey) - 1 AS pos FROM (SELECT DISTINCT l_partkey FROM lineitem)) SELECT key, l_returnflag AS voice, pos, l_orderkey, l_linenumber FROM k JOIN lineitem ON key = l_partkey AND l_returnflag = ['A', 'N', 'R'][pos % 3 + 1]"


def variant_plan(spark, sf_dir):
    """Suppliers in every nation's style, and which of these a customer's artefact already covers."""
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"))
    styles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("style"))
    there = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("item"), F.col("c_nationkey").alias("style"))
    return c.done_and_left(c.plan(items, styles), there, ["item", "style"])


VARIANT_PLAN = "SELECT s_suppkey AS item, n_nationkey AS style, EXISTS (SELECT 1 FROM customer WHERE c_custkey % 100 = s_suppkey AND c_nationkey = n_nationkey) AS done FROM supplier CROSS JOIN nation"


def microbatch_choices(spark, sf_dir):
    """Probed sizes of each supplier; later observed failures override, then the largest that passed is taken."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"))
    probes = s.select("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("size")).withColumn("outcome", F.when((F.col("model") + F.col("size")) % 5 == 0, "OOM").otherwise("PASSED"))
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 40).alias("model"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("event_id") % 3 + 1).cast("int")).alias("size"), "event_id", F.when(F.col("event_id") % 4 == 0, "PASSED").otherwise("OOM").alias("outcome"))
    return c.first_passed(c.overridden(probes, failed, ["model", "size"], "event_id"), "model", "size")


MICROBATCH_CHOICES = """WITH p AS (SELECT s_suppkey AS model, unnest([1, 2, 4]) AS size FROM supplier), f AS (SELECT user_id % 40 AS model, [1, 2, 4][event_id % 3 + 1] AS size, arg_max(CASE WHEN event_id % 4 = 0 THEN 'PASSED' ELSE 'OOM' END, event_id) AS o FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT model, max(CASE WHEN coalesce(o, CASE WHEN (model + size) % 5 = 0 THEN 'OOM' ELSE 'PASSED' END) = 'PASSED' THEN size END) AS chosen FROM p LEFT JOIN f USING (model, size) GROUP BY model"""


def nested_ids(spark, sf_dir):
    """Distinct ids of a nested array in JSON, with the rows that name each."""
    lists = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.array(F.struct((F.col("o_custkey") % 50).alias("id")), F.struct((F.col("o_orderkey") % 70).alias("id"))).alias("items"))).alias("j"))
    ids = lists.select("o_orderkey", F.explode(F.from_json("j", "items array<struct<id: bigint>>")["items"]["id"]).alias("id"))
    return ids.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


NESTED_IDS = "SELECT id, count(*) AS rows FROM (SELECT o_orderkey, o_custkey % 50 AS id FROM orders UNION SELECT o_orderkey, o_orderkey % 70 FROM orders) GROUP BY id"


def index_headers(spark, sf_dir):
    """What is wrong with the protected index of each source."""
    d = table(spark, sf_dir, "documents").select("source", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 6).alias("h"))
    i = d.groupBy("source").agg(F.sort_array(F.collect_set("h")).alias("hashes"), F.count(F.lit(1)).alias("count"), F.xxhash64("source").alias("x"))
    n = F.length("source") + F.conv(F.substring(F.sha2("source", 256), 1, 2), 16, 10).cast("int")
    i = i.withColumns({"schema": F.when(n % 3 == 0, "index").otherwise("protected-index"), "version": F.when(n % 2 == 0, "2.0").otherwise("1.0"), "normaliser": F.when(n % 5 == 0, "nfd").otherwise("nfc-surface")})
    i = i.withColumn("hashes", F.when(n % 4 == 0, F.reverse("hashes")).otherwise(F.col("hashes")))
    return i.select("source", F.array_join(c.index_issues(), ",").alias("issues"))


INDEX_HEADERS = """WITH i AS (SELECT source, count(*) AS n, count(DISTINCT substr(sha256(coalesce(text, '')), 1, 6)) AS k, length(source) + ('0x' || substr(sha256(source), 1, 2))::INT AS x FROM documents GROUP BY source)
SELECT source, concat_ws(',', CASE WHEN x % 3 = 0 THEN 'schema' END, CASE WHEN x % 2 = 0 THEN 'version' END, CASE WHEN x % 5 = 0 THEN 'normaliser' END, CASE WHEN x % 4 = 0 AND k > 1 THEN 'order' END, CASE WHEN n <> k THEN 'count' END) AS issues FROM i"""


def gate_verification(spark, sf_dir):
    """Gates by customers' segments: rows, index coverage and digests against what is expected of them."""
    k = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("gate"), F.floor(F.col("o_orderkey") / 6).alias("index"), F.substring(F.sha2(F.col("o_orderpriority"), 256), 1, 8).alias("digest"))
    k = k.where("not (gate = 1 and index % 50 = 3)")
    expected = k.groupBy("gate").agg((F.count(F.lit(1)) + F.when(F.col("gate") == 2, 1).otherwise(0)).alias("rows"), F.collect_set("digest").alias("digests"))
    expected = expected.withColumn("digests", F.when(F.col("gate") == 3, F.array(F.lit("none"))).otherwise(F.col("digests")))
    return c.gate_issues(k, "index", "digest", expected).select("gate", F.array_join("issues", ",").alias("issues"))


GATE_VERIFICATION = """WITH k AS (SELECT o_orderkey % 6 AS gate, o_orderkey // 6 AS i FROM orders WHERE NOT (o_orderkey % 6 = 1 AND o_orderkey // 6 % 50 = 3))
SELECT gate, concat_ws(',', CASE WHEN gate = 2 THEN 'rows' END, CASE WHEN count(DISTINCT i) <> count(*) OR min(i) <> 0 OR max(i) <> count(*) - 1 THEN 'index_coverage' END, CASE WHEN gate = 3 THEN 'digests' END) AS issues FROM k GROUP BY gate"""


def view_summary(spark, sf_dir):
    """Rows, durations, repeated hashes and status of each view; repeats are allowed only in the first role."""
    d = table(spark, sf_dir, "documents").select(role(F.col("doc_id")).alias("view"), "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    copies = d.groupBy("view", "lang", "h").agg(F.count(F.lit(1)).alias("n"))
    repeats = copies.groupBy("view", "lang").agg(F.sum(F.col("n") - 1).alias("repeats"))
    s = d.groupBy("view", "lang").agg(F.count(F.lit(1)).alias("rows"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"))
    allowed = (F.col("view") == "synthetic_candidate") | (F.col("repeats") == 0)
    return s.join(repeats, ["view", "lang"]).withColumn("status", F.when(allowed, "PASSED").otherwise("FAILED"))


VIEW_SUMMARY = f"""SELECT *, CASE WHEN view = 'synthetic_candidate' OR repeats = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT {duck.role()} AS view, lang, count(*) AS rows, min(coalesce(n_chars, 0)) AS least, max(coalesce(n_chars, 0)) AS most,
round(avg(coalesce(n_chars, 0)), 4) AS mean, count(*) - count(DISTINCT coalesce(text, '')) AS repeats FROM documents GROUP BY 1, 2)"""

QUERIES = {
    "partition_issues": (partition_issues, PARTITION_ISSUES),
    "grouped_roles": (grouped_roles, GROUPED_ROLES),
    "minimal_pair_groups": (minimal_pair_groups, MINIMAL_PAIR_GROUPS),
    "expanded_decisions": (expanded_decisions, EXPANDED_DECISIONS),
    "split_predictions": (split_predictions, SPLIT_PREDICTIONS),
    "public_summary": (public_summary, PUBLIC_SUMMARY),
    "metric_histograms": (metric_histograms, METRIC_HISTOGRAMS),
    "selection_ranks": (selection_ranks, SELECTION_RANKS),
    "holdout_ledger": (holdout_ledger, HOLDOUT_LEDGER),
    "worker_shards": (worker_shards, WORKER_SHARDS),
    "merged_banks": (merged_banks, MERGED_BANKS),
    "probe_rotation": (probe_rotation, PROBE_ROTATION),
    "variant_plan": (variant_plan, VARIANT_PLAN),
    "microbatch_choices": (microbatch_choices, MICROBATCH_CHOICES),
    "nested_ids": (nested_ids, NESTED_IDS),
    "index_headers": (index_headers, INDEX_HEADERS),
    "gate_verification": (gate_verification, GATE_VERIFICATION),
    "view_summary": (view_summary, VIEW_SUMMARY),
}
