"""Operator 2: language identification by Bayesian fusion of evidence.

The posterior of a language is the product of independent evidence, in logarithms:
text      naive Bayes on hashed byte trigrams; the mean log likelihood counts as at most TRIGRAMS trigrams, as neighbours aren't independent
declared  the language the markup (or the record) declares: right with probability RELIABLE
suffix    the address suffix, by the languages seen with it
host      the languages seen at the host, shrunk to those of its suffix, shrunk to those of the whole table (strengths HOST, SUFFIX)

Likelihoods are fitted on at most SAMPLE documents of each of the LANGUAGES most frequent languages, chosen by the hash of their ids (of rows that share an id and
a language the least text); the counts of hosts and suffixes
are grouped aggregates over all rows, joined by broadcast only if a check finds few rows. The host's prior leaves the
row's own declaration out, so that no evidence counts twice.

Beside the languages stands "none of these": its mean log likelihood is a floor under the language that the text fits
best. The floor is calibrated on the documents that the likelihoods are fitted on, each judged without its own counts:
all but a share STRAY of them lie above it, and it is at least LEAST_SLACK under their median. The mean of a few trigrams
scatters, so under TRIGRAMS trigrams the floor's distance grows with the root of their number: very short texts are
judged by the other evidence alone. A text in no known language keeps the nearest one's name, with a small posterior.

Null or empty text gives language "und", which is rejected; so is a best posterior under ACCEPT. Null host, suffix or
declaration is no evidence. Repeated rows get equal results. An empty table, or no labelled text, gives "und"
everywhere it gives rows. Texts of any length are counted whole. All columns are kept; of clashing names the operator's own stay."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, join_checked, lower_ascii, materialize, small_batches, table, texts_of, with_row

SAMPLE = 6_000
#: A model has the languages that are declared most often, so many at most (ties by name); a declaration of another is no evidence.
LANGUAGES = 256
BUCKETS = 1 << 15
TRIGRAMS = 200
RELIABLE = 0.9
HOST, SUFFIX = 20.0, 50.0
ACCEPT = 0.5
#: Prior probability of no known language; the share of labelled documents that may lie under the floor; the floor's least distance from their median.
NONE = 0.01
STRAY = 0.001
LEAST_SLACK = 1.0


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # BUCKETS x languages
    usual: np.ndarray | None = None  # by language: median of the labelled documents' mean log likelihood
    slack: np.ndarray | None = None  # by language: how far TRIGRAMS trigrams may lie under it; without these every text is in some language


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = LANGUAGES) -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(key).isNotNull())
    met = {r["l"]: r["count"] for r in labelled.groupBy(F.col(lang).alias("l")).count().orderBy(F.desc("count"), "l").limit(most).collect()}
    if not met:
        return None
    languages = sorted(met)
    # of a frequent language only hashes under a bound are ranked, with room enough that `sample` of them remain
    bounds = [(l, min(1.0, (1.5 * sample + 1000) / n)) for l, n in met.items()]
    bounds = spark.createDataFrame(bounds, "l string, share double")
    hashed = labelled.select(key, F.col(lang).alias("l"), F.xxhash64(F.col(key)).alias("h")).join(F.broadcast(bounds), "l")
    hashed = hashed.where((F.col("share") >= 1) | (F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))).distinct()
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h", key)))
    ids = materialize(ranked.where(F.col("rank") <= sample).select(key, "l"), "sample")
    number = {l: i for i, l in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for l, t in zip(batch.column("l").to_pylist(), texts_of(batch, "__text"), strict=True):
                if l in number:
                    held.setdefault(l, np.zeros(BUCKETS, dtype=np.int64))
                    held[l] += np.bincount(trigrams(t), minlength=BUCKETS)
        for l, c in held.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([number[l]] * len(b), pa.int32()), pa.array(b, pa.int32()), pa.array(c[b])], ["l", "b", "c"])

    # one text an id, however often an id is repeated, so that the sample's bound holds
    rows = join_checked(labelled.select(key, F.col(lang).alias("l"), F.col(text).alias("__text")), ids, [key, "l"], "inner").groupBy(key, "l").agg(F.min("__text").alias("__text"))
    rows = materialize(rows.select("l", "__text"), "texts")
    counts = np.zeros((BUCKETS, len(languages)))
    got = rows.mapInArrow(count, "l int, b int, c long").groupBy("l", "b").agg(F.sum("c").alias("c")).toPandas()  # BUCKETS x languages at most
    counts[got["b"].to_numpy(), got["l"].to_numpy()] = got["c"].to_numpy()
    smooth = counts + 0.5
    total = smooth.sum(axis=0)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for l, t in zip(batch.column("l").to_pylist(), texts_of(batch, "__text"), strict=True):
                if l in number and t.strip():
                    i, seen = number[l], np.bincount(grams := trigrams(t), minlength=BUCKETS)
                    at = np.flatnonzero(seen)
                    mean = seen[at] @ np.log((smooth[at, i] - seen[at]) / (total[i] - len(grams))) / len(grams)
                    for o, x in zip(out, (i, float(mean), len(grams)), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int32(), pa.float64(), pa.int64()), strict=True)], ["l", "mean", "n"])

    fits = rows.mapInArrow(left_out, "l int, mean double, n long").toPandas()  # three numbers for each document of the sample
    usual, slack = np.full(len(languages), -np.log(BUCKETS)), np.full(len(languages), LEAST_SLACK)
    for i, own in fits.groupby("l"):
        usual[i] = own["mean"].median()
        short = (usual[i] - own["mean"]) * np.sqrt(np.minimum(own["n"], TRIGRAMS) / TRIGRAMS)
        slack[i] = max(LEAST_SLACK, float(np.quantile(short, 1 - STRAY, method="higher")))
    return Model(languages, np.log(smooth / total), usual, slack)


def identify(df: DataFrame, model: Model | None, text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None, accept: float = ACCEPT) -> DataFrame:
    """All columns and language, posterior (of that language), text_language (by the text alone) and rejected."""
    small_batches(df.sparkSession)
    own = ["language", "posterior", "text_language", "rejected"]
    languages = model.languages if model else []
    column = lambda c: F.col(c) if c else F.lit(None).cast("string")
    rows = df.select(carried(df, own), F.col(text).alias("__text"), column(declared).alias("__declared"), column(host).alias("__host"), column(suffix).alias("__suffix"))

    def counted(*by: str) -> DataFrame:
        """Declarations by language, as an array in the languages' order."""
        return rows.select(*by, "__declared").groupBy(*by).agg(F.array(*(F.sum(F.when(F.col("__declared") == l, 1).otherwise(0)) for l in languages)).alias("n"))

    if model:
        overall = np.array((counted().first() or [[0] * len(languages)])[0] or [0] * len(languages), dtype=float) + 1
        overall /= overall.sum()
        if host or suffix:
            rows = join_checked(rows, materialize(counted("__suffix").withColumnRenamed("n", "__by_suffix"), "suffixes"), "__suffix")
            rows = join_checked(rows, materialize(counted("__suffix", "__host").where("__host is not null").groupBy("__host").agg(F.array(*(F.sum(F.col("n")[i]) for i in range(len(languages)))).alias("__by_host")), "hosts"), "__host")
    if not model or not (host or suffix):
        rows = rows.withColumns({"__by_suffix": F.lit(None).cast("array<bigint>"), "__by_host": F.lit(None).cast("array<bigint>")})
        overall = overall if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {l: i for i, l in enumerate(languages)}
        wrong = (1 - RELIABLE) / max(1, len(languages) - 1)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t, d, by_host, by_suffix in zip(texts_of(batch, "__text"), *(batch.column(c).to_pylist() for c in ("__declared", "__by_host", "__by_suffix")), strict=True):
                if not model or not t.strip():
                    for o, x in zip(out, ("und", 0.0, "und", True), strict=True):
                        o.append(x)
                    continue
                grams = trigrams(t)
                seen = np.bincount(grams, minlength=BUCKETS)
                at = np.flatnonzero(seen)
                by_text = (seen[at] @ model.log_likelihood[at]) / len(grams) * min(len(grams), TRIGRAMS)
                own_ = number.get(d)
                less = lambda n: np.maximum(0, np.array(n or [0] * len(languages), dtype=float) - (np.arange(len(languages)) == own_))
                prior = overall
                if by_suffix:
                    n = less(by_suffix)
                    prior = (n + SUFFIX * prior) / (n.sum() + SUFFIX)
                if by_host:
                    n = less(by_host)
                    prior = (n + HOST * prior) / (n.sum() + HOST)
                total = by_text + np.log(prior)
                if own_ is not None:
                    total = total + np.log(np.where(np.arange(len(languages)) == own_, RELIABLE, wrong or 1.0))
                p = np.exp(total - total.max())
                none = 0.0
                if model.usual is not None:
                    k, near = min(len(grams), TRIGRAMS), int(np.argmax(by_text))
                    floor = model.usual[near] - model.slack[near] * np.sqrt(TRIGRAMS / k)
                    none = np.exp(min(700.0, floor * k + np.log(NONE) - (np.log(len(languages)) if own_ is not None else 0.0) - total.max()))
                p /= p.sum() + none
                best = int(np.argmax(p))
                for o, x in zip(out, (languages[best], float(p[best]), languages[int(np.argmax(by_text))], bool(p[best] < accept)), strict=True):
                    o.append(x)
            arrays = [pa.array(o, k) for o, k in zip(out, (pa.string(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *arrays], ["__row", *own])

    rows = rows.select("__row", "__text", "__declared", "__by_host", "__by_suffix")
    return rows.mapInArrow(run, with_row(rows, "language string, posterior double, text_language string, rejected boolean")).select("__row.*", *own)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text (of the markup, without tags), declared, host and suffix (last label of the host and first part of the path)."""
    host = lower_ascii(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2})", 1))
    return pages.select(
        "page_id",
        body.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract("url", r"(?s)://[^/?#]*/([A-Za-z]{2})(?:/|$)", 1)).alias("suffix"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), declared="lang", host="source")
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "rejected")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on markup, where declarations, suffixes and hosts come from the pages."""
    model = train(table(spark, sf_dir, "documents"))
    found = identify(page_evidence(table(spark, sf_dir, "pages")), model, declared="declared", host="host", suffix="suffix")
    return found.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "rejected")
