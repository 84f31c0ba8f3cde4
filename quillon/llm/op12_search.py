"""Operator 12: ranked lexical search by TPUT (three phases with a uniform threshold) over term-partitioned postings.

Postings are written as lists: by term, then by falling impact, dealt out by ranges, so that a frequent term's list lies in
many files. Phase one fetches the head of every list; the k-th best sum of what a query's heads give is a lower bound of its
k-th score. Phase two divides that bound by the number of the query's lists and fetches from each list all impacts above it;
what a document can still gain from lists where it wasn't seen bounds its score from above, and documents below the lower
bound go. Phase three raises the bound to the k-th best sum known now, and looks up the exact scores of the documents that
can still reach it and were not seen in full. Fetched impacts go to the documents' partitions once, and are dealt to queries
there, so that nothing travels per query. All steps are exact: ties of the k-th score are kept until documents are ranked.

Terms are the contract's, A-Z lower-cased; a score is the sum of integer impacts. Null and empty texts hold no term and are
not counted. Every row is a document of its own: repeated rows rank one after another, and rows with a null key come after
those with equal scores. Every row of the queries is a query of its own; one without terms gives no rows. Long texts are
counted whole. Empty tables give an empty table. Other columns are left out; keys may have any name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, join_checked, lower_ascii, materialize, small_batches, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The bytes of a text with A-Z lower-cased and all that parts terms as spaces.
LETTERS = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
K = 10
#: The queries' distinct terms go to all tasks if they take at most so many bytes; else every term is posted.
TERM_BYTES = 16 << 20


def terms_of(text: str):
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))


def posted(df: DataFrame, key: str, text: str, wanted: set[bytes] | None) -> DataFrame:
    """A row per document with a term: uid, key, n (terms with repeats), terms (distinct; wanted ones only, if given) and tfs."""
    small_batches(df.sparkSession)
    allowed = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = allowed.value
        for batch in batches:
            rows, sizes, ends, terms, tfs = [], [], [0], [], []
            for i, cell in enumerate(batch.column(2)):
                words = cell.as_py().translate(LETTERS).split()
                if words:
                    counts = Counter(words)
                    held = [(t, c) for t, c in counts.items() if t in only] if only is not None else counts.items()
                    terms += [t for t, _ in held]
                    tfs += [c for _, c in held]
                    rows.append(i)
                    sizes.append(len(words))
                    ends.append(len(terms))
            at = pa.array(rows, pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()), *lists], ["uid", "key", "n", "terms", "tfs"])

    source = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, f"uid long, key {df.schema[key].dataType.simpleString()}, n long, terms array<string>, tfs array<long>")


def impacts(docs: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """uid, tid, impact of each posting whose term has a weight."""
    m = F.expr(f"100 - 90 + ((90L * n * {n_docs}L) div {max(1, n_terms)}L)")
    rows = docs.select("uid", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("uid", "m", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    rows = join_checked(rows, weights, "term", "inner")
    return rows.select("uid", "tid", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("impact")).where("impact > 0")


def kth(sums: DataFrame, value: str, k: int, otherwise: int) -> DataFrame:
    """item and `bound`: its k-th largest value, or `otherwise` if it has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col(value).desc(), "uid"))
    best = sums.select("item", value, place.alias("place")).where(F.col("place") <= k)
    return best.groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min(value)).otherwise(F.lit(otherwise)).cast("long").alias("bound"))


def search(df: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_key, rank, key and score of each query's k best documents."""
    # the queries' terms
    items = materialize(queries.select(F.col(query_key).alias("name"), F.array_distinct(terms_of(query_text)).alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    asking = items.select("item", F.explode("terms").alias("term"))
    distinct = materialize(asking.select("term").distinct(), "terms")
    small = bounded(distinct) and (distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= TERM_BYTES
    wanted = {r.term.encode() for r in distinct.toLocalIterator()} if small else None

    # postings, first by document, then by term and falling impact
    docs = materialize(posted(df, key, text, wanted), "posted")
    n_docs, n_terms = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df_of = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = df_of.join(distinct, "term", "left_semi").select("term", w.alias("w")).where("w > 0")
    weights = materialize(weights.withColumn("tid", F.monotonically_increasing_id()), "weights")
    lists = impacts(docs, weights, n_docs, n_terms).repartitionByRange("tid", F.col("impact").desc(), "uid").sortWithinPartitions("tid", F.col("impact").desc())
    lists = materialize(lists, "lists")

    # phase one: heads
    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.col("impact").desc(), "uid"))
    heads = materialize(lists.withColumn("place", place).where(F.col("place") <= k).drop("place"), "heads")
    most = heads.groupBy("tid").agg(F.max("impact").alias("most"))
    asked = join_checked(asking, weights.select("term", "tid"), "term", "inner").select("item", "tid")
    sums = join_checked(heads, asked, "tid", "inner").groupBy("item", "uid").agg(F.sum("impact").alias("sum"))
    per_item = asked.groupBy("item").agg(F.count(F.lit(1)).alias("m")).join(kth(sums, "sum", k, 0), "item")
    # impacts above `floor` are fetched; `gain` is the most that a list gives a document that isn't
    asked = asked.join(per_item, "item").join(most, "tid").withColumn("floor", F.expr("greatest(0L, (bound - 1) div m)")).withColumn("gain", F.least("floor", "most"))
    asked = materialize(asked.select("item", "tid", "bound", "floor", "gain"), "asked")

    # phase two: the uniform threshold
    lowest = asked.groupBy("tid").agg(F.min("floor").alias("lowest"))
    fetched = join_checked(lists, lowest, "tid", "inner").where("impact > lowest").select("tid", "uid", "impact").repartition("uid")
    seen = join_checked(fetched, asked.select("tid", "item", "floor", "gain"), "tid", "inner").where("impact > floor")
    seen = seen.groupBy("uid", "item").agg(F.sum("impact").alias("sum"), F.sum("gain").alias("gained"))
    all_gains = asked.groupBy("item").agg(F.sum("gain").alias("gains"), F.max("bound").alias("bound"))
    seen = join_checked(seen, all_gains, "item", "inner").withColumn("upper", F.expr("sum + gains - gained")).where("upper >= bound")
    seen = materialize(seen.select("item", "uid", "sum", "upper"), "seen")

    # phase three: exact scores
    left = seen.join(kth(seen, "sum", k, 1), "item").where("upper >= bound").select("item", "uid", "sum", "upper")
    left = materialize(left, "candidates")
    exact = left.where("upper = sum").select("item", "uid", F.col("sum").alias("score"))
    unsure = left.where("upper > sum").select("item", "uid")
    if not unsure.isEmpty():
        rows = join_checked(docs, unsure.select("uid").distinct(), "uid", "left_semi")
        found = impacts(rows, weights, n_docs, n_terms)
        want = join_checked(unsure, asked.select("item", "tid"), "item", "inner")
        exact = exact.unionAll(want.join(found, ["uid", "tid"]).groupBy("item", "uid").agg(F.sum("impact").alias("score")))
    named = exact.join(docs.select("uid", "key"), "uid")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "uid"))
    best = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return join_checked(best, items.select("item", "name"), "item", "inner").select(F.col("name").alias(query_key), "rank", F.col("key").alias(key), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT uid, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM counted),
postings AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM (SELECT uid, doc_id, n, unnest(terms) AS term FROM counted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, total GROUP BY term, n_docs),
impacts AS (
  SELECT uid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN weights USING (term), total),
items AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark WHERE text IS NOT NULL),
scores AS (
  SELECT item, item_id, uid, doc_id, CAST(sum(impact) AS BIGINT) AS score
  FROM (SELECT item, item_id, unnest(terms) AS term FROM items) JOIN impacts USING (term) GROUP BY item, item_id, uid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, uid) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
