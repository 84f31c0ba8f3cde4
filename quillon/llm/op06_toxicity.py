"""Operator 6: severity of toxic text by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality. One weight vector w is shared by all thresholds
t1 < t2: P(grade >= k) = sigmoid(w.x - tk). The expected severity is the sum of these probabilities. Features are
hashed words and word beginnings (PREFIX letters) that a text holds, scaled to length one; those whose likelihood ratio between toxic and other
sampled documents reaches RATIO are kept, the best FEATURES of them. The model is fitted on at most SAMPLE labelled
documents of each grade, chosen by the hash of their ids and weighted to the grades' shares among all labels;
everything else covers all rows.

Null and empty text has no features and severity 0 (nothing to judge). Null labels are not used; a label whose quality
is null counts as grade 1 if toxic. Of several labels of one id the highest grade counts, of several texts of a labelled id
the least one. Texts of any length are read whole, in memory in proportion to the longest. Without labels of both kinds every severity is 0. Repeated rows score alike. An
empty table gives an empty table. All columns are kept; of clashing names the operator's own stay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, materialize, small_batches, table, texts_of, with_row

SAMPLE = 5_000
FEATURES = 8_192
PREFIX = 6
#: A feature met in fewer sampled documents says nothing.
LEAST = 3
#: Twice the logarithm of the likelihood ratio; chance alone reaches it about once in fifteen thousand features.
RATIO = 16.0
BUCKETS = 1 << 22
#: Probability of being toxic from which a text is rejected; on held-out labels it rejects fewer than one clean text in a thousand.
REJECT = 0.35
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*%#-_/\\…«»“”„’"
CACHE = 400_000


def features_of(token: str) -> tuple[int, ...]:
    """Hashed features of one white-space token."""
    word = token.strip(EDGE)
    if not word:
        return ()
    whole = zlib.crc32(b"w" + word.encode()) % BUCKETS
    return (whole, zlib.crc32(b"p" + word[:PREFIX].encode()) % BUCKETS) if len(word) >= PREFIX else (whole,)


class Found:
    """Features that texts hold; tokens met before are looked up."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.kept = wanted, {}

    def of(self, text: str) -> set[int]:
        kept, found = self.kept, set()
        for t in set(text.lower().split()):
            f = kept.get(t)
            if f is None:
                f = features_of(t)
                if self.wanted is not None:
                    f = tuple(self.wanted[x] for x in f if x in self.wanted)
                if len(kept) >= CACHE:
                    kept.clear()
                if len(t) <= 64:
                    kept[t] = f
            if f:
                found.update(f)
        return found


@dataclass
class Model:
    wanted: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, found: set[int]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[i] for i in found) / max(1, len(found)) ** 0.5
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -500, 500)))


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, shares: np.ndarray, steps: int = 300, rate: float = 0.2, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by maximum likelihood with Adam. Cells (row, column) are the features held; shares: of the grades among all labels."""
    n, most = len(grades), len(shares) - 1
    order = np.argsort(cols, kind="stable")
    scale = 1 / np.sqrt(np.bincount(rows, minlength=n).clip(1))
    c_rows = rows[order]
    weight = (shares / np.bincount(grades, minlength=most + 1).clip(1))[grades]
    weight /= weight.sum()
    w, low, gaps = np.zeros(n_features), 0.0, np.zeros(most - 1)
    state = [np.zeros(n_features + most) for _ in range(2)]
    for step in range(1, steps + 1):
        t = low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, weights=w[cols], minlength=n) * scale
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -30, 30)))  # P(grade >= k)
        upper = np.column_stack([np.ones(n), above])[np.arange(n), grades]
        lower = np.column_stack([above, np.zeros(n)])[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        d_score = -(du - dl)
        d_t = np.zeros(most)
        has = grades > 0
        np.add.at(d_t, grades[has] - 1, du[has])
        has = grades < most
        np.add.at(d_t, grades[has], -dl[has])
        d_w = np.bincount(cols[order], weights=(d_score * scale)[c_rows], minlength=n_features) + penalty * w
        d_gaps = np.cumsum(d_t[::-1])[::-1][1:] * np.exp(gaps)
        grad = np.concatenate([d_w, [d_t.sum()], d_gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, low, gaps = w - move[:n_features], low - move[n_features], gaps - move[n_features + 1 :]
    return w, low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def sampled(labels: DataFrame, key: str, grade: str, n: int) -> DataFrame:
    """At most n rows of each grade, by the hash of their keys: key and grade. The bound makes it fit for a broadcast."""
    parts = [labels.where(F.col(grade) == g).select(key, F.col(grade).alias("grade")).orderBy(F.xxhash64(F.col(key)), key).limit(n) for g in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, n_features: int = FEATURES) -> Model | None:
    """labels: key, toxic, quality."""
    small_batches(docs.sparkSession)
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    graded = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(grade).alias("grade"))
    graded = materialize(graded, "grades")
    chosen = materialize(sampled(graded, key, "grade", sample), "sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([list(found.of(t)) for t in texts_of(batch, "__text")], pa.list_(pa.int32()))], ["grade", "features"])

    # one text an id, however often an id is repeated, so that the sample's bound holds
    rows = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("__text").alias("__text"), F.min("grade").alias("grade"))
    rows = materialize(rows.select("grade", "__text").mapInArrow(extract, "grade int, features array<int>"), "features")
    size = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sum(n for g, n in size.items() if g), size.get(0, 0)
    if not toxic or not other:
        return None
    met = rows.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("grade") > 0, 0).otherwise(1)).alias("b"))
    met = met.where(F.col("a") + F.col("b") >= LEAST)

    def part(seen, of: int):  # log likelihood of `seen` hits in `of` documents at their own rate
        p = seen / of
        return F.when(p > 0, seen * F.log(p)).otherwise(0.0) + F.when(p < 1, (of - seen) * F.log(1 - p)).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), toxic) + part(F.col("b"), other) - part(F.col("a") + F.col("b"), toxic + other))
    best = met.withColumn("ratio", ratio).where(F.col("ratio") >= RATIO).orderBy(F.desc("ratio"), "f").limit(n_features)
    wanted = {r["f"]: i for i, r in enumerate(best.select("f").collect())}
    if not wanted:
        return None
    only = rows.select("grade", F.array_intersect("features", F.array(*(F.lit(f) for f in wanted))).alias("features")).collect()  # the sample, a few features each
    cells = np.array([(i, wanted[f]) for i, r in enumerate(only) for f in r["features"]], dtype=np.int64).reshape(-1, 2)
    labelled = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = np.array([labelled.get(g, 0) for g in range(3 if size.get(2) else 2)], dtype=float)
    weights, thresholds = fit(cells[:, 0], cells[:, 1], np.array([r["grade"] for r in only]), len(wanted), shares / shares.sum())
    return Model(wanted, weights, thresholds)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns and p_toxic, severity (expected grade), grade (most likely) and rejected (p_toxic >= REJECT)."""
    small_batches(docs.sparkSession)
    own = ["p_toxic", "severity", "grade", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(model.wanted) if model else None
        for batch in batches:
            p_toxic, severity, grade = [], [], []
            for t in texts_of(batch, "__text"):
                p = model.probabilities(found.of(t)) if found and t.strip() else np.zeros(1)
                p_toxic.append(float(p[0]))
                severity.append(float(p.sum()))
                grade.append(int(np.argmax(np.concatenate([[1.0], p]) - np.concatenate([p, [0.0]]))))
            arrays = [pa.array(p_toxic), pa.array(severity), pa.array(grade, pa.int32()), pa.array([p >= REJECT for p in p_toxic])]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *arrays], ["__row", *own])

    rows = docs.select(carried(docs, own), F.col(text).alias("__text"))
    return rows.mapInArrow(run, with_row(rows, "p_toxic double, severity double, grade int, rejected boolean")).select("__row.*", *own)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.round("p_toxic", 6).alias("p_toxic"), F.round("severity", 6).alias("severity"), "grade", "rejected")
