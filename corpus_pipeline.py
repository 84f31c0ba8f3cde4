"""The training-data pipeline: five stages over the documents, each one operator of quillon.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of the documents.
A row whose doc_id is null is judged like any other where a stage judges rows, and left as it is where a stage needs the
id to tell documents apart. Repeated rows with one doc_id and one text are one document after the near-duplicate stage; of a
group of near copies the smallest id stays, of equal rows the first by lang, source and n_chars. Null and empty texts hold no
words: no stage but the language's rejects them, and they pack as an end id. Texts of any length are judged whole. Columns of
the documents beyond the five named are dropped at the first stage, whatever their names. Empty tables pass as empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import op01_substring, op02_language, op03_packing, op06_toxicity, op07_bpe, op08_simhash
from quillon.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, trained on all labels, doesn't reject."""
    model = op06_toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op06_toxicity.score(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with more probability than not."""
    model = op02_language.train(docs)
    found = op02_language.identify(docs, model, declared="lang", host="source")
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8 or more): the one with the smallest id.

    A document is an id with its text (by 128 bits), so that different texts under one id are judged apart; of equal ones
    the first by the other columns stays."""
    who = F.struct("doc_id", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))
    named = docs.where("doc_id is not null").withColumn("__who", who)
    found = op08_simhash.near_copies(named.select("__who", "text"), "__who")
    stays = found.where(F.col("__who") == F.col("component_id")).select("__who").distinct()
    first = F.row_number().over(Window.partitionBy("__who").orderBy("lang", "source", "n_chars"))
    kept = named.join(stays, "__who", "left_semi").withColumn("__first", first).where("__first = 1")
    return kept.select(*COLUMNS).unionAll(docs.where("doc_id is null").select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; untouched ones keep their text as it is."""
    found = op01_substring.substring_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens in sequences."""
    return op03_packing.packed_digest(op03_packing.pack(docs, op07_bpe.vocabulary()))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
