"""Operator 3: harmonic packing of tokenised documents into sequences of bounded length.

Every document becomes ids plus an end id. A document is cut into pieces whose lengths fit reciprocal-capacity classes
exactly: whole sequences, then the binary halves of the capacity down to SMALL, then a rest below SMALL. Class k holds
pieces of lengths in (capacity/(k+1), capacity/k], and each of its bins takes exactly k pieces. Every task fills its
own bins; nothing is shuffled. What is left in open bins when a task ends is strung together, cut at the capacity, and
the last of it at powers of two, which need no padding. So only bins of the smallest classes are padded.

Null text counts as empty: one piece with the end id. Texts of any length, and with runs of any length, are encoded whole. Ties and repeated rows need no rule: pieces are placed in the
order they arrive. An empty table gives no pieces. Other columns are left out. A task keeps at most capacity ids per class."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import fast_ids
from .common import release, small_batches, table
from .op07_bpe import vocabulary

CAPACITY = 2048
END = 1
#: Ids of placed pieces that a task gathers before it gives them on.
HELD = 250_000
#: Rests below this length are not cut further.
SMALL = 128
FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_le", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def cut(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of a document's pieces: full ones, then halves of the capacity, then a rest."""
    out = [capacity] * (n // capacity)
    rest, half = n % capacity, capacity // 2
    while rest >= small and half >= small:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Bins of one task. A piece is (key, start, ids, doc_tokens); a placed piece has its sequence and offset too."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open, self.out, self.held = capacity, first, defaultdict(list), [], 0

    def close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.out.append((*p, self.next, at))
            at += len(p[2])
        self.held += at
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // len(piece[2])
        bin_ = self.open[k]
        bin_.append(piece)
        if len(bin_) == k:
            self.close(bin_)
            self.open[k] = []

    def finish(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in left)
        sizes = cut(total, self.capacity, 1)
        now: list = []
        room = sizes.pop(0) if sizes else 0
        for key, start, ids, n in left:
            while len(ids):
                take = min(room, len(ids))
                now.append((key, start, ids[:take], n))
                start, ids, room = start + take, ids[take:], room - take
                if not room:
                    self.close(now)
                    now, room = [], sizes.pop(0) if sizes else 0
        self.open.clear()


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: key, start, length, ids_le (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset. The key can't be called like another of these."""
    if key in dict(FIELDS):
        raise ValueError(f"the operator makes {key} itself")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def told(kind) -> pa.RecordBatch:
            rows, bins.out, bins.held = bins.out, [], 0
            cols = [[p[0] for p in rows], [p[1] for p in rows], [len(p[2]) for p in rows], [p[2].tobytes() for p in rows], [p[3] for p in rows], [p[4] for p in rows], [p[5] for p in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *(t for _, t in FIELDS)], strict=True)], [key, *(n for n, _ in FIELDS)])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(fast_ids(path, t.as_py() or ""), np.uint32(end)).astype("<u4")
                start = 0
                for n in cut(len(ids), capacity):
                    bins.add((k, start, ids[start : start + n], len(ids)))
                    start += n
                if len(bins.out) >= 4000 or bins.held >= HELD:
                    yield told(kind)
        bins.finish()
        if bins.out:
            yield told(kind)

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents"), vocabulary()))
