"""Operator 1: substring dedup by relative Lempel-Ziv parsing against anchored reference blocks.

A window is WINDOW consecutive words. A window's anchor is the least hash among its runs of GRAM words, so equal windows
have equal anchors, and neighbouring windows with one anchor form one passage; each window lies in exactly one passage
whole. The corpus is its own reference, cut into blocks by anchor: a passage can match only passages of its block.

1. Every document gives its passages (anchor, 128-bit hash of the words, place). Anchors met once are dropped.
2. Passages met twice or more are duplicates whole: a parse against a block that holds them has one factor. Blocks with
   one distinct passage need nothing else.
3. In blocks with several, the words of the distinct passages are indexed by their suffixes in order, and each passage
   met once is parsed greedily into longest matches against the whole block. Factors of WINDOW words or more become
   spans; at each factor's end the places inside it are checked for a match that crosses the boundary (see parsing).
4. A block has to fit a task: one of more than BLOCK distinct passages is indexed again by grams as long as a window,
   which makes a block of each distinct window, and rule 2 decides.

A word is known by 128 bits, which are its own bytes under 16 of them; a passage by two 64-bit hashes of these and its anchor.

All words of the spans are removed. Windows are judged on the input.

Null and empty text has no words and removes nothing; documents shorter than a window too. Repeated rows are copies of
each other. Null keys are keys like others. Texts of any length are parsed whole. An empty table gives an empty table. All columns are kept; of clashing names
n_words, n_removed, kept and spans the operator's own stay. A task holds one batch of documents, or blocks of up to BLOCK passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, materialize, release, small_batches, table, texts_in_row, texts_of, with_row
from .parsing import OTHER_BASE, factors, gram_hashes, longest_matches, window_anchors, word_hashes

WINDOW = 35
GRAM = 8
#: The most distinct passages of a block that is indexed in one task.
BLOCK = 10_000
#: Words of the blocks that are indexed together.
CHUNK = 200_000
KEYS = ["__k1", "__k2"]
OWN = ["n_words", "n_removed", "kept", "spans"]


def passages(data: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, two hashes, first window and windows of each passage."""
    words, others = word_hashes(data)
    anchor, first, n = window_anchors(words, window, gram)
    said, also = np.empty(len(anchor), dtype=np.uint64), np.empty(len(anchor), dtype=np.uint64)
    long_ = n + window - 1
    for size in np.unique(long_):
        at = long_ == size
        said[at] = gram_hashes(words, int(size))[first[at]] + np.uint64(size)
        also[at] = gram_hashes(others, int(size), OTHER_BASE)[first[at]]
    return anchor, said, also, first, n


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for k1, k2, t in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts_of(batch, "__text"), strict=True):
                anchor, said, also, first, n = passages(t.encode(), window, gram)
                for c, x in zip(cols, (np.full(len(n), k1), np.full(len(n), k2), anchor.view(np.int64), said.view(np.int64), also.view(np.int64), first.astype(np.int32), n.astype(np.int32)), strict=True):
                    c.append(x)
            if sum(map(len, cols[0])):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], [*KEYS, "anchor", "said", "also", "first", "n"])

    return run


def _words_of(window: int):
    """From documents with their wanted passages to the passages' words; for blocks too large for a task to windows by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, t, wanted in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "__text", "wanted")), strict=True):
                data = (t or "").encode()
                words, hashes = data.split(), None
                for w in wanted:
                    if w["large"]:
                        if hashes is None:
                            a, b = word_hashes(data)
                            hashes = gram_hashes(a, window).view(np.int64), gram_hashes(b, window, OTHER_BASE).view(np.int64)
                        rows += [(k1, k2, int(hashes[0][i]), int(hashes[1][i]), i, w["met"] > 1, None) for i in range(w["first"], w["first"] + w["n"])]
                    else:
                        rows.append((k1, k2, w["anchor"], 0, w["first"], w["met"] > 1, b" ".join(words[w["first"] : w["first"] + w["n"] + window - 1])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000], strict=True), kinds, strict=True)], [*KEYS, "anchor", "also", "first", "whole", "words"])

    return run


def parse_block(passages_: list[bytes], whole: list[bool], window: int) -> list[list[tuple[int, int]]]:
    """The factors of each passage against all the others and its own other places. whole: met again elsewhere, so it needs none."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    bounds = [0]
    for i, p in enumerate(passages_):
        ids += [known.setdefault(w, len(known)) for w in p.split(b" ")]
        ids.append(-1 - i)  # matches nothing
        bounds.append(len(ids))
    longest = longest_matches(np.array(ids, dtype=np.int64), 64)
    return [[] if whole[i] else factors(longest[bounds[i] : bounds[i + 1] - 1], window) for i in range(len(passages_))]


def _parse(window: int, chunk: int):
    """Rows come sorted by anchor; whole blocks are indexed together up to `chunk` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []
        size, last = 0, None

        def parsed() -> pa.RecordBatch:
            found = parse_block([h[3] for h in held], [h[4] for h in held], window)
            rows = [(h[0], h[1], h[2] + a, h[2] + b) for h, fs in zip(held, found, strict=True) for a, b in fs]
            held.clear()
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*KEYS, "from", "to"])

        for batch in batches:
            for k1, k2, anchor, first, whole, words in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "anchor", "first", "whole", "words")), strict=True):
                if anchor != last and size >= chunk:
                    yield parsed()
                    size = 0
                last = anchor
                held.append((k1, k2, first, words, whole))
                size += words.count(b" ") + 2
        if held:
            yield parsed()

    return run


def _remove(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for t, found in zip(texts_in_row(batch, text), batch.column("__spans").to_pylist(), strict=True):
                words = t.encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for s in found or []:
                    gone[s["from"]] += 1
                    gone[s["to"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                spans.append([{"from": a, "to": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words).decode())
            own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *own], ["__row", *OWN])

    return run


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """All columns of df, n_words, n_removed, kept (words left, joined by one space) and spans (array of from and to, in words)."""
    if text in OWN:
        raise ValueError(f"the text column can't be called {text}, which the operator makes itself")
    small_batches(df.sparkSession)
    k1, k2 = F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("__k1"), F.xxhash64(F.lit(2), F.col(text), F.col(key)).alias("__k2")
    docs = df.select(carried(df, OWN), F.col(text).alias("__text"), k1, k2)

    met = materialize(docs.select(*KEYS, "__text").mapInArrow(_index(window, gram), "__k1 long, __k2 long, anchor long, said long, also long, first int, n int"), "passages")
    who = F.struct("said", "also")
    again = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min(who).alias("a"), F.max(who).alias("b")).where("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    again = materialize(again, "again")  # as a table of its own both sides of the join are plain shuffles, and AQE splits an anchor that many passages share
    flagged = materialize(met.join(again, "anchor"), "repeated")

    span = lambda x: (F.col("first") + x).alias("to")
    simple = flagged.where(~F.col("mixed")).select(*KEYS, F.col("first").alias("from"), span(F.col("n") + (window - 1)))
    mixed = flagged.where("mixed")
    distinct = mixed.groupBy("anchor", "said", "also").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct(*KEYS, "first", "n")).alias("at"))
    distinct = materialize(distinct, "distinct")
    twice = materialize(distinct.where("met > 1").select("anchor", "said", "also"), "twice")  # a table of its own, as again
    whole = mixed.join(twice, ["anchor", "said", "also"], "left_semi").select(*KEYS, F.col("first").alias("from"), span(F.col("n") + (window - 1)))

    many = distinct.groupBy("anchor").count().where(F.col("count") > block).select("anchor", F.lit(True).alias("large"))
    wanted = distinct.join(materialize(many, "large"), "anchor", "left").select("at.*", "anchor", "met", F.coalesce("large", F.lit(False)).alias("large"))
    wanted = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("first", "n", "anchor", "met", "large")).alias("wanted"))
    said = docs.select(*KEYS, "__text").join(wanted, KEYS).mapInArrow(_words_of(window), "__k1 long, __k2 long, anchor long, also long, first int, whole boolean, words binary")
    # a row of the input that is there twice brings its passages twice
    said = materialize(said.dropDuplicates([*KEYS, "first"]), "words")
    blocks = said.where("words is not null").repartition("anchor").sortWithinPartitions("anchor")
    parsed = blocks.mapInArrow(_parse(window, chunk), "__k1 long, __k2 long, `from` int, `to` int")
    windows = said.where("words is null")
    counted = materialize(windows.groupBy("anchor", "also").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", "also"), "windows")
    crossed = windows.where(~F.col("whole")).join(counted, ["anchor", "also"], "left_semi").select(*KEYS, F.col("first").alias("from"), span(F.lit(window)))

    spans = simple.unionAll(whole).unionAll(parsed).unionAll(crossed)
    spans = spans.groupBy(*KEYS).agg(F.collect_set(F.struct("from", "to")).alias("__spans"))  # a set, so that copies of a row count once
    spans = materialize(spans, "spans")  # so that AQE can split a row that is repeated very often in the join
    joined = docs.drop("__text").join(spans, KEYS, "left").select("__row", "__spans")  # the text travels once, in its row
    out = joined.mapInArrow(_remove(text), with_row(docs, "n_words long, n_removed long, kept string, spans array<struct<`from`:int,`to`:int>>"))
    return out.select("__row.*", *OWN)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM words WHERE len(w) >= {WINDOW})
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM windows SEMI JOIN again USING (h)
), removed AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""
