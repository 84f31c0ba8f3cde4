"""Contracts of gates and reviews: rows of an immutable gate, reason codes as people write them, segments that may be used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import contracts
from ..sources.tables import table
from . import duck

CODES = ("STEEL;BRASS", '["STEEL", " TIN "]', "", "steel", '["STEEL", 1]', '["STEEL"', "A,B1", '["NOT_OK:X", "A-B"]', '[]', '["a"]', "TOO_LONG_" * 8)


def reason_codes_parsed(spark, sf_dir):
    """Codes of each part, written in turn as lists, JSON, with other types, broken or blank."""
    said = F.element_at(F.array(*(F.lit(c) for c in CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.parsed_codes(said).alias("c")).select("p_partkey", F.array_join("c.codes", "|").alias("codes"), "c.malformed")


def gate_manifest(spark, sf_dir):
    """Documents as a gate: some of another role, type or language, ids that come again, and paths that are written in two ways."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n % 13 != 0, "immutable_real_gate").alias("partition_role"), F.when(n % 17 != 0, "public_real").otherwise("tts").alias("source_type"), F.when(n % 19 != 0, "sl-SI").otherwise(F.col("lang")).alias("target_lang"),
        F.when(n % 23 != 0, F.concat(F.lit("s"), F.when(n % 5 == 0, F.floor(n / 10) * 10).otherwise(n))).otherwise(F.lit(" ")).alias("sample_id"),
        F.when(n % 7 == 0, F.concat(F.lit("/a/./x/../"), (n - 1).cast("string"), F.lit(".wav"))).otherwise(F.concat(F.lit("//a/"), n.cast("string"), F.lit(".wav"))).alias("audio_filepath"),
    )
    return contracts.gate_rows(d, "immutable_real_gate", "public_real", "sl-SI", "doc_id").select("doc_id", "reason")


def usable_segments(spark, sf_dir):
    """Documents that may be used as segments: of other sources, neither short nor long, and with no form among the protected texts.

    Every fourth document is protected: as it stands, squeezed, by its surface or by its surface with numbers masked, in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("n_chars") / 15).alias("duration"))
    some = table(spark, sf_dir, "documents").where("doc_id % 4 = 0 and text is not null").select("doc_id", t.composed(F.col("text")).alias("x"))
    s = t.surface_form(F.col("x"))
    turn = F.floor(F.col("doc_id") / 4) % 4
    known = some.select(F.when(turn < 2, "reference").when(turn == 2, "surface").otherwise("number_masked").alias("view"), t.fingerprint(F.when(turn == 0, F.col("x")).when(turn == 1, t.squeezed(F.col("x"))).when(turn == 2, s).otherwise(t.masked(s))).alias("hash"))
    excluded = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return contracts.eligible_segments(d, excluded, known, "text", "source", "duration", 10, 200).select("doc_id", "source")


_PARSED = "CASE p_partkey % 11 WHEN 0 THEN 'STEEL|BRASS' WHEN 1 THEN 'STEEL|TIN' WHEN 7 THEN 'NOT_OK:X|A-B' ELSE '' END"
SQL = {
    # a single letter is no code, so `A,B1` is malformed
    "reason_codes_parsed": f"SELECT p_partkey, {_PARSED} AS codes, p_partkey % 11 IN (3, 4, 5, 6, 9, 10) AS malformed FROM part",
    "gate_manifest": """WITH r AS (SELECT doc_id AS n, CASE WHEN doc_id % 13 = 0 THEN 'role' WHEN doc_id % 17 = 0 THEN 'source_type' WHEN doc_id % 19 = 0 AND lang IS DISTINCT FROM 'sl-SI' THEN 'language' WHEN doc_id % 23 = 0 THEN 'sample_id' END AS rule,
  CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 's' || CASE WHEN doc_id % 5 = 0 THEN doc_id // 10 * 10 ELSE doc_id END END AS id, CASE WHEN doc_id % 7 = 0 THEN doc_id - 1 ELSE doc_id END AS path FROM documents)
SELECT n AS doc_id, CASE WHEN rule IS NOT NULL THEN rule WHEN EXISTS (SELECT 1 FROM r b WHERE b.rule IS NULL AND b.id = a.id AND b.n < a.n) THEN 'duplicate_sample_id' WHEN EXISTS (SELECT 1 FROM r b WHERE b.rule IS NULL AND b.path = a.path AND b.n < a.n) THEN 'duplicate_audio_filepath' END AS reason FROM r a""",
    "usable_segments": f"""WITH d AS (SELECT doc_id, source, n_chars, text, nfc_normalize(text) AS x FROM documents), e AS (SELECT *, {duck.squeeze('x')} AS q, {duck.surface('x')} AS s FROM d), f AS (SELECT *, {duck.masked('s')} AS m FROM e),
p AS (SELECT *, doc_id // 4 % 4 AS turn FROM f WHERE doc_id % 4 = 0 AND x IS NOT NULL), refs AS (SELECT CASE WHEN turn = 0 THEN x ELSE q END AS h FROM p WHERE turn < 2)
SELECT doc_id, source FROM f WHERE n_chars / 15 BETWEEN 10 AND 200 AND trim(x) <> '' AND NOT regexp_matches(text, '(#[{duck.W}-]+|\\(\\)[{duck.W}-]*)') AND source NOT IN ('src1', 'src2')
  AND x NOT IN (SELECT h FROM refs) AND q NOT IN (SELECT h FROM refs) AND s NOT IN (SELECT s FROM p WHERE turn = 2) AND m NOT IN (SELECT m FROM p WHERE turn = 3)""",
}
QUERIES = {f.__name__: (f, SQL[f.__name__]) for f in (reason_codes_parsed, gate_manifest, usable_segments)}
