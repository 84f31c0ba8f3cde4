"""Operator 7: byte-pair encoding and decoding of whole texts (see bytebpe for the method).

Null text counts as empty: no ids, an empty decoded text. Long texts need memory in proportion to the longest one.
Rows keep their order and number; repeated rows give repeated results; an empty table gives an empty table; other
columns are kept, and of a clashing name the operator's own column stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import bpe
from .common import small_batches, table, texts_of


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and n_tokens, ids (little-endian numbers of 16 bits, or 32 for large vocabularies), ids_text (decimals joined by commas)."""
    small_batches(df.sparkSession)
    own = {"n_tokens", "ids", "ids_text"}
    kept = [c for c in keep if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        width = int(coder.kind[-1])
        for batch in batches:
            ids, said, n = [], [], []
            for t in texts_of(batch, "__text"):
                parts = coder.encode_parts(t)
                ids.append(b"".join([p[0] for p in parts]))
                said.append(",".join([p[1] for p in parts]))
                n.append(sum(len(p[0]) for p in parts) // width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(said, pa.string())], [*kept, "n_tokens", "ids", "ids_text"])

    source = df.select(*kept, F.col(text).alias("__text"))
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "n_tokens long, ids binary, ids_text string"]))


def decode(df: DataFrame, path: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep` and text, from the column ids of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = bpe(path)
        for batch in batches:
            said = [coder.decode_bytes(np.frombuffer(x or b"", dtype=coder.kind)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(said, pa.string())], [*keep, "text"])

    return df.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "text string"]))


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, so that ids need not travel. The key can't be called like another of these."""
    if key in ("n_tokens", "ids_sha256", "decoded_sha256"):
        raise ValueError(f"the operator makes {key} itself")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = bpe(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for t in texts_of(batch, "__text"):
                parts = coder.encode_parts(t)
                ids = np.frombuffer(b"".join([p[0] for p in parts]), dtype=coder.kind)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                back = coder.decode_bytes(ids).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
