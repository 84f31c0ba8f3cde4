"""Queries over single texts: normal forms, keys, log values, identifiers, flags and row contracts, each through the library's functions.

The DuckDB statements are written from the definitions, apart from the Spark side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import text as t
from ..operators import contracts, decisions
from ..sources.tables import pairs, table
from . import duck

#: Digits as words, for spoken keys.
DIGITS = ("nula", "ena", "dve", "tri", "štiri", "pet", "šest", "sedem", "osem", "devet")


def _text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))


def text_squeezed(spark, sf_dir):
    c = t.composed(F.col("text"))
    return _text(spark, sf_dir).select("doc_id", t.fingerprint(t.squeezed(c)).alias("squeezed_sha256"), t.stable_hash(F.col("text")).alias("stable_sha256"), t.fingerprint(t.folded(t.squeezed(c))).alias("folded_sha256"))


_SQUEEZED = duck.squeeze("nfc_normalize(coalesce(text, ''))")
TEXT_SQUEEZED = f"SELECT doc_id, sha256({_SQUEEZED}) AS squeezed_sha256, sha256(nfc_normalize(coalesce(text, ''))) AS stable_sha256, sha256(replace(lower({_SQUEEZED}), 'ß', 'ss')) AS folded_sha256 FROM documents"


def pair_jaccard(spark, sf_dir):
    """Distinct case-folded words of a turn and of the turn before."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", t.token_set(F.col("reference")).alias("a"), t.token_set(F.col("hypothesis")).alias("b"))
    return p.select("conv_id", "turn", F.size("a").cast("long").alias("left_words"), F.size("b").cast("long").alias("right_words"), F.round(t.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_PAIRS = "p AS (SELECT * FROM (SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference, text AS hypothesis FROM conversations) WHERE reference IS NOT NULL)"
_SET = lambda x: f"list_distinct(list_filter(string_split_regex(replace(lower({x}), 'ß', 'ss'), '[^{duck.W}]+'), lambda x: x <> ''))"
PAIR_JACCARD = f"""WITH {_PAIRS}, s AS (SELECT conv_id, turn, {_SET('reference')} AS a, {_SET('hypothesis')} AS b FROM p), n AS (SELECT *, len(list_intersect(a, b)) AS c FROM s)
SELECT conv_id, turn, len(a)::BIGINT AS left_words, len(b)::BIGINT AS right_words, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE c / (len(a) + len(b) - c) END, 6) AS jaccard FROM n"""


def generated_lines(spark, sf_dir):
    """Page titles as a model's list items, cleaned."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" 12) \""), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("\"  ")).alias("line"))
    return p.select("page_id", t.clean_generated_line(F.col("line")).alias("listed"), t.clean_line(F.col("line")).alias("plain"))


_LINE = "concat(' 12) \"', coalesce(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), ''), '\"  ')"
_CLEAN = lambda x: duck.squeeze(f"regexp_replace(trim({x}), '^[\"''“”„`]+|[\"''“”„`]+$', '', 'g')")
_UNMARKED = lambda x: f"regexp_replace(trim({x}), '^\\s*(?:[0-9]{{1,4}}[).:\\-]\\s*|[-*•]\\s*)', '')"
_BARE = lambda x: duck.squeeze(f"regexp_replace({_UNMARKED(x)}, '^[ \t\"''“”„`]+|[ \t\"''“”„`]+$', '', 'g')")
GENERATED_LINES = f"SELECT page_id, CASE WHEN html IS NULL THEN NULL ELSE {_BARE(_LINE)} END AS listed, CASE WHEN html IS NULL THEN NULL ELSE {_CLEAN(_LINE)} END AS plain FROM pages"


def sentence_lines(spark, sf_dir):
    """Usable sentences of each text and their characters."""
    s = t.sentences(_text(spark, sf_dir), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("characters"), F.max(F.length("sentence")).cast("long").alias("longest"))


_RAW = "unnest(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS raw"
SENTENCE_LINES = f"""WITH l AS (SELECT doc_id, {_RAW}, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS o FROM documents),
s AS (SELECT doc_id, o, trim(regexp_replace(raw, '^{duck.S}+|{duck.S}+$', '', 'g')) AS s FROM l),
f AS (SELECT *, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS fences FROM s),
k AS (SELECT doc_id, {_BARE('s')} AS line FROM f
  WHERE NOT starts_with(s, '```') AND fences % 2 = 0 AND s <> '' AND NOT regexp_full_match(s, '(?i)\\s*(?:json|candidates?|sentences?|stavki?|output|response)\\s*:?\\s*')
  AND NOT (ends_with(s, ':') AND len(list_filter(string_split_regex(s, '{duck.S}+'), lambda x: x <> '')) <= 5)),
p AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(line, '([.!?])\\s+([A-ZČŠŽ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS sentence FROM k WHERE line <> '' AND NOT regexp_matches(line, '^[{{}}\\[\\]]'))
SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS characters, max(length(sentence)) AS longest FROM p WHERE sentence <> '' GROUP BY doc_id"""


def spoken_keys(spark, sf_dir):
    digits = F.create_map(*(x for i, w in enumerate(DIGITS) for x in (F.lit(str(i)), F.lit(w))))
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    return p.select("page_id", t.spoken_key(F.col("url"), digits).alias("spoken"))


_SAID = "regexp_replace(lower(strip_accents(coalesce(url, ''))), '([0-9])', ' \\1 ', 'g')"
_WORD = "CASE x " + " ".join(f"WHEN '{i}' THEN '{w}'" for i, w in enumerate(DIGITS)) + " ELSE x END"
SPOKEN_KEYS = f"SELECT page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace({_SAID}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: {_WORD}), ' ') AS spoken FROM pages"


def sentinels(spark, sf_dir):
    """Sentinel texts there and back; every seventh is broken on purpose."""
    d = _text(spark, sf_dir).withColumn("said", t.sentinel_text(F.format_string("s%05d", "doc_id"), F.col("text")))
    d = d.withColumn("said", F.when(F.col("doc_id") % 7 == 0, F.replace("said", F.lit("\t"), F.lit(" "))).otherwise(F.col("said")))
    return d.select("doc_id", t.fingerprint(F.col("said")).alias("said_sha256"), t.sentinel_id(F.col("said")).alias("sample_id"))


SENTINELS = """WITH s AS (SELECT doc_id, '__sample__:s' || lpad(doc_id::VARCHAR, 5, '0') || chr(9) || coalesce(text, '') AS said FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(said, chr(9), ' ') ELSE said END AS said FROM s)
SELECT doc_id, sha256(said) AS said_sha256, CASE WHEN starts_with(said, '__sample__:') AND instr(said, chr(9)) > 12 THEN substr(said, 12, instr(said, chr(9)) - 12) END AS sample_id FROM b"""


def log_values(spark, sf_dir):
    """The last transcript and the last duration that a log of several lines shows, one log per user."""
    e = table(spark, sf_dir, "events")
    line = F.format_string("Final streaming transcriptions: ['%s %d', 'x']\nThe whole streaming process took: %.2fs", "event_type", "event_id", "value")
    logs = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("log"))
    return logs.select("user_id", t.last_transcript(F.col("log")).alias("transcript"), t.active_seconds(F.col("log")).alias("seconds"))


LOG_VALUES = "SELECT user_id, arg_max(event_type || ' ' || event_id, event_id) AS transcript, printf('%.2f', arg_max(value, event_id))::DOUBLE AS seconds FROM events GROUP BY user_id"


def json_hashes(spark, sf_dir):
    d = _text(spark, sf_dir)
    return d.select("doc_id", t.flat_json_hash(("source", F.col("source")), ("lang", F.col("lang")), ("id", F.col("doc_id"))).alias("payload_sha256"))


JSON_HASHES = """SELECT doc_id, sha256('{"id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS payload_sha256 FROM documents"""


def composite_ids(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    return o.select("l_orderkey", "l_linenumber", t.composite_id(F.col("l_returnflag"), (F.col("l_orderkey") % 24).cast("int"), F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 10000).cast("int")).alias("id"))


COMPOSITE_IDS = "SELECT l_orderkey, l_linenumber, l_returnflag || '-s' || lpad((l_orderkey % 24)::VARCHAR, 2, '0') || '-a' || lpad(l_linenumber::VARCHAR, 3, '0') || '-o' || lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS id FROM lineitem"


def carriers_stripped(spark, sf_dir):
    """Texts in carrier phrases: the longest prefix and suffix go, prohibited patterns too."""
    words = F.concat(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("pove"), F.lit("da"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("pove"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("doc"), F.col("lang"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("na"), F.lit("koncu"))).otherwise(F.array().cast("array<string>")))
    known = lambda *xs: F.array(*(F.lit(x) for x in xs))
    d = _text(spark, sf_dir).withColumn("w", words)
    form = F.concat(F.lit("skupina <NUM> pove da "), F.col("lang"), F.lit(" row <NUM> konec"))
    return d.select("doc_id", t.strip_carrier(F.col("w"), known("pove da", "pove"), known("na koncu", "koncu")).alias("inner"), t.without_prohibited(form).alias("clean"), t.prohibited(form).alias("prohibited"))


CARRIERS_STRIPPED = "SELECT doc_id, 'doc ' || lang || ' ' || doc_id AS inner, lang || ' row <NUM> konec' AS clean, true AS prohibited FROM documents"


def flags_and_codes(spark, sf_dir):
    """Tri-state flags and reason lists in their several spellings."""
    said = F.element_at(F.array(*(F.lit(x) for x in ("TRUE ", "yes", "0", "no", "maybe", "", "1"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    codes = F.when(F.col("p_size") % 2 == 0, F.concat_ws("; ", F.split("p_type", " "))).otherwise(F.to_json(F.split("p_type", " ")))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", t.tri_state(said).alias("flag"), F.array_join(t.reason_codes(codes), "|").alias("codes"), decisions.review_status(t.reason_codes(codes), ("STEEL", "BRASS")).alias("status"))


FLAGS_AND_CODES = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 5 THEN false WHEN 6 THEN true END AS flag, replace(p_type, ' ', '|') AS codes,
CASE WHEN list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS']) THEN 'TEXT_REJECTED' ELSE 'DRAFT' END AS status FROM part"""


def metric_values(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rate, base = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return l.select(
        "l_orderkey",
        "l_linenumber",
        F.round(m.relative_improvement(F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(rate), base), 6).alias("improvement"),
        m.error_bucket(rate * base).alias("error_bucket"),
        m.duration_bucket(base).alias("duration_bucket"),
        F.round(m.perplexity(rate / 8), 4).alias("perplexity"),
        F.round(m.decibels(rate, base), 6).alias("decibels"),
        F.round(m.hard_score(F.col("l_linenumber") == 1, rate, base), 6).alias("hard_score"),
        F.round(m.chunk_seconds(F.array(F.lit(56), F.col("l_linenumber").cast("int"))), 6).alias("chunk_seconds"),
    )


METRIC_VALUES = """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS r, l_linenumber::DOUBLE AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_orderkey % 5 = 0 OR r = 0 THEN 0.0 ELSE (r - b) / r * 100 END, 6) AS improvement,
CASE WHEN r * b = 0 THEN '0' WHEN r * b <= 25 THEN '0-25' WHEN r * b <= 50 THEN '25-50' WHEN r * b <= 75 THEN '50-75' WHEN r * b <= 100 THEN '75-100' ELSE 'over-100' END AS error_bucket,
CASE WHEN b < 2 THEN 'short_lt_2s' WHEN b <= 5 THEN 'medium_2_to_5s' ELSE 'long_gt_5s' END AS duration_bucket, round(exp(least(r / 8, 50)), 4) AS perplexity, round(20 * log10(r / b), 6) AS decibels,
round(CASE WHEN b = 1 THEN 1000.0 ELSE 0.0 END + r + 0.25 * b, 6) AS hard_score, round((b + 1) * 0.08, 6) AS chunk_seconds FROM v"""


def _records(spark, sf_dir):
    """Text records with faults spread over them."""
    c = F.col
    spoken = F.concat(F.lit("besedilo "), c("lang"), F.lit(" številka "), c("doc_id").cast("string"), F.when(c("doc_id") % 17 == 0, " <b>x</b>").when(c("doc_id") % 19 == 0, " 5 €").when(c("doc_id") % 23 == 0, "  dvojno").otherwise(""))
    struct = "struct<family_id: string, contrast: string>"
    return _text(spark, sf_dir).select(
        "doc_id",
        F.when(c("doc_id") % 29 == 0, "1.0").otherwise("2.0").alias("schema_version"),
        F.concat(F.when(c("doc_id") % 31 == 0, "bad id ").otherwise("c-"), c("doc_id").cast("string")).alias("candidate_id"),
        F.when(c("doc_id") % 37 == 0, "de-DE").otherwise("sl-SI").alias("language"),
        F.lit("synthetic_candidate").alias("partition_role"),
        F.when(c("doc_id") % 41 == 0, "unknown").when(c("doc_id") % 2 == 0, "generated_text").otherwise("public_domain").alias("source_type"),
        spoken.alias("spoken_text"),
        F.when(c("doc_id") % 43 == 0, F.lit("drugo besedilo tu")).otherwise(spoken).alias("target_text"),
        F.concat(F.lit("src-"), c("source")).alias("source_id"),
        F.lit("family-1").alias("source_family_id"),
        F.lit("utt-1").alias("utterance_family_id"),
        F.lit(None).cast("string").alias("template_family_id"),
        F.when(c("doc_id") % 47 != 0, F.array(c("lang"))).alias("phenomena"),
        F.when(c("doc_id") % 53 == 0, "").otherwise(c("lang")).alias("domain"),
        F.lit("cc0").alias("license"),
        F.when(c("doc_id") % 2 == 0, F.lit("{}")).alias("generation"),
        F.lit(None).cast("array<struct<surface: string, type: string>>").alias("entities"),
        F.when(c("doc_id") % 59 == 0, F.struct(F.lit("pair-1").alias("family_id"), F.lit("").alias("contrast"))).cast(struct).alias("minimal_pair"),
    )


def record_contract(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", contracts.text_record("synthetic_candidate").alias("reason"))


RECORD_CONTRACT = r"""WITH s AS (SELECT doc_id, lang, source, 'besedilo ' || lang || ' številka ' || doc_id || CASE WHEN doc_id % 17 = 0 THEN ' <b>x</b>' WHEN doc_id % 19 = 0 THEN ' 5 €' WHEN doc_id % 23 = 0 THEN '  dvojno' ELSE '' END AS spoken FROM documents)
SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'schema_version' WHEN doc_id % 31 = 0 THEN 'candidate_id' WHEN doc_id % 37 = 0 THEN 'language' WHEN doc_id % 41 = 0 THEN 'source_type' WHEN contains(spoken, '  ') THEN 'text_form' WHEN doc_id % 43 = 0 THEN 'text_differs'
WHEN length(spoken) > 240 THEN 'character_count' WHEN contains(spoken, '<b>') THEN 'markup' WHEN contains(spoken, '€') THEN 'symbol' WHEN NOT regexp_full_match('src-' || source, '[A-Za-z0-9][A-Za-z0-9._-]{1,127}') THEN 'source_id' WHEN doc_id % 47 = 0 THEN 'phenomena' WHEN doc_id % 53 = 0 THEN 'domain_or_license' WHEN doc_id % 59 = 0 THEN 'minimal_pair' END AS reason FROM s"""


def legacy_contract(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("is_protected", F.col("doc_id") % 61 == 0)
    return r.select("doc_id", contracts.legacy_record("synthetic_candidate", ("en", "fr", "de"), protected=True, most=40).alias("reason"))


LEGACY_CONTRACT = r"""WITH s AS (SELECT doc_id, lang, CASE WHEN doc_id % 43 = 0 THEN 'drugo besedilo tu' ELSE 'besedilo ' || lang || ' številka ' || doc_id || CASE WHEN doc_id % 17 = 0 THEN ' <b>x</b>' WHEN doc_id % 19 = 0 THEN ' 5 €' WHEN doc_id % 23 = 0 THEN '  dvojno' ELSE '' END END AS target FROM documents)
SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'candidate_id' WHEN doc_id % 37 = 0 THEN 'language' WHEN length(target) > 40 THEN 'length' WHEN contains(target, '<b>') THEN 'markup' WHEN doc_id % 47 = 0 OR lang NOT IN ('en', 'fr', 'de') THEN 'phenomena' WHEN doc_id % 61 = 0 THEN 'protected' END AS reason FROM s"""


def manifest_contract(spark, sf_dir):
    d = _text(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "real_gate").otherwise("selected_training").alias("partition_role"), F.when(F.col("source") == "src1", "licensed").otherwise("tts").alias("source_type"), "lang", F.lit("en").alias("target_lang"), (F.col("n_chars") / 15.0 - 20).alias("duration"), "text")
    kept = contracts.forbidden_rows(d, "partition_role").select("doc_id", F.lit(True).alias("forbidden"))
    return d.join(kept, "doc_id", "left").select("doc_id", contracts.manifest_row("selected_training", "tts", "en").alias("reason"), F.coalesce("forbidden", F.lit(False)).alias("forbidden"))


MANIFEST_CONTRACT = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'role' WHEN source = 'src1' THEN 'source_type' WHEN lang IS NULL OR lang <> 'en' THEN 'language' WHEN n_chars / 15.0 - 20 <= 0 THEN 'duration' WHEN trim(coalesce(text, '')) = '' THEN 'text' END AS reason, doc_id % 10 = 0 AS forbidden FROM documents"""


def log_lines(spark, sf_dir):
    line = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("epoch ", "transcript ", "", "step 5 /home/x ", "loss 5% ", "note "))), (F.col("event_id") % 6 + 1).cast("int")), F.when(F.col("event_id") % 6 != 2, F.col("event_type")).otherwise(F.lit(" ")))
    return table(spark, sf_dir, "events").groupBy("event_type", contracts.log_line(line).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


LOG_LINES = "SELECT event_type, CASE event_id % 6 WHEN 0 THEN 'show' WHEN 1 THEN 'redact' WHEN 2 THEN 'drop' WHEN 3 THEN 'redact' WHEN 4 THEN 'show' ELSE 'drop' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2"

QUERIES = {
    "text_squeezed": (text_squeezed, TEXT_SQUEEZED),
    "pair_jaccard": (pair_jaccard, PAIR_JACCARD),
    "generated_lines": (generated_lines, GENERATED_LINES),
    "sentence_lines": (sentence_lines, SENTENCE_LINES),
    "spoken_keys": (spoken_keys, SPOKEN_KEYS),
    "sentinels": (sentinels, SENTINELS),
    "log_values": (log_values, LOG_VALUES),
    "json_hashes": (json_hashes, JSON_HASHES),
    "composite_ids": (composite_ids, COMPOSITE_IDS),
    "carriers_stripped": (carriers_stripped, CARRIERS_STRIPPED),
    "flags_and_codes": (flags_and_codes, FLAGS_AND_CODES),
    "metric_values": (metric_values, METRIC_VALUES),
    "record_contract": (record_contract, RECORD_CONTRACT),
    "legacy_contract": (legacy_contract, LEGACY_CONTRACT),
    "manifest_contract": (manifest_contract, MANIFEST_CONTRACT),
    "log_lines": (log_lines, LOG_LINES),
}
