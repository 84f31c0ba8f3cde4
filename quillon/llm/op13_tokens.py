"""Operator 13: token counts by overlap resynchronisation.

A text of more than STRIDE characters is dealt out as chunks that overlap by OVERLAP, so that one huge text is work for many
tasks. Each chunk is split and encoded by itself, with the offsets of its pieces. The split reads from left to right and
keeps no state: from a place where a piece truly begins, it depends only on what follows. So where a piece begins in both of
two neighbouring chunks, and the left one is right there, the right one is right from there on; the first chunk is right from
its start, and any chunk is right up to MARGIN characters (and a special token) before its end, which is as far as the split
looks ahead. The two are spliced at their first such common place. A text with a seam without one (a run longer than the
overlap) goes round again with the overlap doubled, at last as a single chunk.

Null text counts as empty: no bytes, no tokens. Texts may be of any length: a chunk holds STRIDE + overlap characters, and
the overlap grows only where a text has no boundary. Rows keep their number: null and repeated keys and repeated rows are
counted one by one; an empty table gives an empty table. Other columns are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import CACHE, ByteBPE, bpe
from .common import materialize, small_batches, table
from .op07_bpe import vocabulary

STRIDE, OVERLAP = 32_768, 512
#: Characters before a chunk's end in which a piece may come out otherwise than in the whole text, besides a special token.
MARGIN = 4
#: The overlap grows by this factor from round to round.
WIDEN = 8
LIMIT = 512
#: Chunks that are handed on together.
TOGETHER = 64


class Counts(dict):
    """Tokens of each piece of the split, kept for short pieces."""

    def __init__(self, coder: ByteBPE):
        self.coder = coder

    def __missing__(self, piece: str) -> int:
        n = len(self.coder.encode_piece(piece.encode()))
        if len(piece) <= 100:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n

    def runs(self, text: str) -> Iterator[list[str] | None]:
        """The pieces of each run of ordinary text, and None for each special token between them."""
        special = self.coder.special_split
        for i, run in enumerate(special.split(text) if special else [text]):
            yield None if i % 2 else self.coder._cut.findall(run)

    def total(self, text: str) -> int:
        return sum(1 if pieces is None else sum(map(self.__getitem__, pieces)) for pieces in self.runs(text))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins, the end at last, and the tokens before that place."""
        sizes: list[int] = []
        tokens: list[int] = []
        parts = self.coder.special_split.split(text) if self.coder.special_split else [text]
        for part, pieces in zip(parts, self.runs(text), strict=True):
            sizes += [len(part)] if pieces is None else map(len, pieces)
            tokens += [1] if pieces is None else map(self.__getitem__, pieces)
        return np.cumsum([0, *sizes]), np.cumsum([0, *tokens])


_counts: dict[str, Counts] = {}


def counts_of(path: str) -> Counts:
    """One table of counts per worker and vocabulary."""
    if path not in _counts:
        coder = bpe(path)
        special = list(coder.special)
        if any(a[-n:] == b[:n] for a in special for b in special for n in range(1, min(len(a), len(b)) + (a != b)) if n < len(a) or n < len(b)):
            raise ValueError("special tokens may not overlap each other, as their places would depend on what is before")
        _counts[path] = Counts(coder)
    return _counts[path]


def slices(big: DataFrame, stride: int, overlap: int) -> DataFrame:
    """A row per chunk: __uid, k, from (its place in the text), last, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                starts = list(range(0, max(1, len(text) - overlap), stride))
                for i in range(0, len(starts), TOGETHER):
                    at = starts[i : i + TOGETHER]
                    cols = [[uid] * len(at), [s // stride for s in at], at, [s == starts[-1] for s in at], [text[s : s + stride + overlap] for s in at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["__uid", "k", "from", "last", "chunk"])

    return big.select("__uid", "text").mapInArrow(run, "__uid long, k long, from long, last boolean, chunk string")


def seams(chunks: DataFrame, path: str, stride: int, overlap: int) -> DataFrame:
    """For each seam that a chunk takes part in: __uid, seam, right (whether it's the chunk after the seam), total (of a text's last chunk),
    places (of the text) where pieces begin, before (tokens of the chunk before each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path)
        margin = MARGIN + max(map(len, counts.coder.special), default=0)
        for batch in batches:
            rows: list[tuple] = []
            for uid, k, start, last, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, before = counts.offsets(chunk)
                if k:
                    head = at <= overlap
                    rows.append((uid, k - 1, True, int(before[-1]) if last else None, at[head] + start, before[head]))
                if not last:
                    tail = (at >= stride) & (at <= len(chunk) - margin)
                    rows.append((uid, k, False, None, at[tail] + start, before[tail]))
                elif not k:
                    rows.append((uid, -1, True, int(before[-1]), [], []))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["__uid", "seam", "right", "total", "places", "before"])

    return chunks.mapInArrow(run, "__uid long, seam long, right boolean, total long, places array<long>, before array<long>")


def spliced(sides: DataFrame) -> DataFrame:
    """Per text: __uid, n_tokens, or null where a seam has no common place."""
    side = lambda name, right: F.first(F.when(F.col("right") == right, F.col(name)), ignorenulls=True)
    seam = sides.groupBy("__uid", "seam").agg(F.max("total").alias("total"), *(side(c, r).alias(f"{c}_{n}") for c in ("places", "before") for n, r in (("l", False), ("r", True))))
    met = seam.withColumn("place", F.array_min(F.array_intersect("places_l", "places_r")))
    gain = F.expr("before_l[cast(array_position(places_l, place) - 1 as int)] - before_r[cast(array_position(places_r, place) - 1 as int)]")
    gain = F.when(F.col("seam") < 0, F.lit(0)).otherwise(gain)
    per = met.select("__uid", "total", gain.cast("long").alias("gain")).groupBy("__uid")
    per = per.agg(F.count_if(F.col("gain").isNull()).alias("open"), (F.sum("gain") + F.max("total")).alias("n"))
    return per.select("__uid", F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def huge_counts(big: DataFrame, path: str, stride: int, overlap: int) -> DataFrame:
    """__uid, n_tokens for the texts of a written table (__uid, text), round by round with wider overlaps."""
    found, todo = None, big
    while True:
        chunks = slices(todo, max(stride, overlap), overlap).repartition("__uid", "k")
        now = materialize(spliced(seams(chunks, path, max(stride, overlap), overlap)), "spliced")
        done = now.where("n_tokens is not null")
        found = done if found is None else found.unionAll(done)
        left = now.where("n_tokens is null").select("__uid")
        if left.isEmpty():
            return found
        todo, overlap = big.join(left, "__uid", "left_semi"), overlap * WIDEN


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row. The key can't be called like another of these."""
    if key in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"the operator makes {key} itself")
    small_batches(df.sparkSession)
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    one_chunk = F.length("text") <= stride + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(path)
        for batch in batches:
            n = [counts.total(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], [key, "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    found = rows.where(one_chunk).select(key, "n_bytes", "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
    big = materialize(rows.where(~one_chunk).withColumn("__uid", F.monotonically_increasing_id()), "huge")
    if not big.isEmpty():
        found = found.unionAll(big.select("__uid", key, "n_bytes").join(huge_counts(big, path, stride, overlap), "__uid").select(key, "n_bytes", "n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
