"""Operator 9: texts as TIFF media columns, and TIFF media read to one row per page.

to_tiff stores each text's bytes, padded with spaces to a positive multiple of ROW, as gray 8-bit pages of ROW
samples a line and at most PAGE_ROWS lines. The form of a file (codec, predictor, strips or tiles) is one of FORMS, chosen
by the text's checksum unless it is given, so equal texts give equal files and every form is read back. read_pages walks any TIFF column and gives a row per page; a file that
can't be read gives one row with page null and the reason in error. Null text counts as empty, null media as no pages
and the error "no media". Equal inputs give equal outputs, repeated rows are treated alike, an empty table gives an
empty table, other columns are left out unless named in keep, which can't name the operator's own columns. A task holds one Arrow
batch (bounded in bytes; one text may be longer) with its pages decoded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiff
from .common import small_batches, table, texts_of

ROW = 192
PAGE_ROWS = 4096
#: Compression, predictor and tile (height and width; none: strips).
FORMS = ((tiff.DEFLATE, 1, None), (tiff.DEFLATE, 2, None), (tiff.DEFLATE, 1, (64, 96)), (tiff.PACKBITS, 1, None), (tiff.PACKBITS, 1, (16, 64)), (tiff.LZW, 1, None), (tiff.LZW, 2, (32, 96)), (tiff.NONE, 1, None))
PAGE_DDL = "page int, width int, height int, channels int, bits int, compression int, samples binary, feature string"
PAGE_ARROW = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("samples", pa.binary()), ("feature", pa.string())])


def payload(text: str) -> bytes:
    data = text.encode("utf-8")
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def feature(page: tiff.Page) -> str:
    """Size, mean, deviation, mean step between neighbours in a line, and the counts of eight ranges of values."""
    kind = np.uint8 if page.bits == 8 else np.uint16
    image = np.frombuffer(page.samples, dtype=kind).reshape(page.height, page.width * page.channels)
    counts = np.bincount((image >> (page.bits - 3)).ravel(), minlength=8)
    wide = image.astype(np.int32)
    step = np.abs(np.diff(wide, axis=1)).mean() if wide.shape[1] > 1 else 0.0
    return f"{page.width}x{page.height}x{page.channels} mean {wide.mean():.3f} dev {wide.std():.3f} step {step:.3f} hist {' '.join(map(str, counts))}" if wide.size else "empty"


def _free(keep: tuple[str, ...], own: tuple[str, ...]) -> None:
    if clash := set(keep) & set(own):
        raise ValueError(f"the operator makes {sorted(clash)} itself")


def to_tiff(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), form: tuple[int, int, tuple[int, int] | None] | None = None) -> DataFrame:
    """Columns keep, n_bytes and media; form: one of FORMS for all texts."""
    _free(keep, ("n_bytes", "media"))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for t in texts_of(batch, "__text"):
                data = payload(t)
                image = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
                compression, predictor, tile = form or FORMS[zlib.crc32(data) % len(FORMS)]
                n.append(len(t.encode("utf-8")))
                media.append(tiff.write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    ddl = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*ddl, "n_bytes long, media binary"]))


def decode(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, media, pages (array of page structs in the file's order) and error (null if all could be read)."""
    _free(keep, ("media", "pages", "error"))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for m in batch.column("__media").to_pylist():
                own: list[dict] = []
                try:
                    if m is None:
                        raise tiff.Damaged("no media")
                    own += [vars(p) | {"feature": feature(p)} for p in tiff.pages(m)]
                    errors.append(None)
                except tiff.Damaged as e:
                    errors.append(str(e))
                found.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("__media"), pa.array(found, pa.list_(PAGE_ARROW)), pa.array(errors, pa.string())], [*keep, "media", "pages", "error"])

    ddl = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(media).alias("__media")).mapInArrow(run, ", ".join([*ddl, f"media binary, pages array<struct<{PAGE_DDL.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>, error string"]))


def read_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per page: keep, the page's columns and error; a file without pages gives one row."""
    return decode(df, media, keep).select(*keep, "error", F.inline_outer("pages"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = to_tiff(table(spark, sf_dir, "documents"), keep=("doc_id",))
    read = decode(stored, keep=("doc_id", "n_bytes"))
    joined = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["samples"])), ""))  # in one pass, however many pages
    one = F.when(F.size("pages") == 1, F.element_at("pages", 1)["samples"]).otherwise(joined)
    return read.withColumn("payload", one).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("; ", F.concat(F.lit("pages "), F.size("pages").cast("string")), F.transform("pages", lambda p: p["feature"])).alias("feature"),
    )
