"""Writers: canonical JSON lines, reports, manifests, review sheets, event logs. Lines and manifests are written beside their path and then put there as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that identify people or places on disk.
PRIVATE = ("audio_filepath", "reference", "hypothesis", "text", "target_text", "spoken_text", "path", "references")


def canonical(df: DataFrame) -> Column:
    """A row as compact JSON with sorted keys at every level."""

    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    return F.to_json(F.struct(*(ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in a path's place; what stood there goes last. The store has to rename folders as a whole."""
    jvm = spark._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, f"{staged}-before"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(now)
    if there and not fs.rename(now, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(new, now):
        if there:
            fs.rename(old, now)
        raise OSError(f"{staged} can't be moved to {path}")
    if there:
        fs.delete(old, True)


def write_whole(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Write df beside the path, then put it there: a job that fails leaves what was there before, and no reader sees half of it."""
    staged = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        write(df.write, staged)
    except Exception:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        raise
    _replace(df.sparkSession, staged, path.rstrip("/"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A canonical object per line, as a whole (see write_whole). With an order, the parts and the lines in them follow it."""
    rows = df.orderBy(*order) if order else df
    write_whole(rows.select(canonical(df).alias("value")), path, lambda w, p: w.text(p))


def report(df: DataFrame, most: int = 10_000) -> str:
    """Sorted, indented JSON of a small table of aggregates; larger tables are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is of aggregates, not of rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], sort_keys=True, indent=2, ensure_ascii=False, default=str)


def write_manifest(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """A projection whose parts and lines are in order, written as a whole."""
    rows = df.select(*columns, F.col(order).alias("__order")).orderBy("__order").drop("__order")
    write_whole(rows, path, lambda w, p: w.json(p))


def write_review_sheets(df: DataFrame, path: str) -> None:
    """A sheet for people and a template for machines, of the same rows."""
    df.write.option("sep", "\t").option("header", True).csv(f"{path}/sheet")
    df.withColumn("outcome", F.lit("")).write.json(f"{path}/template")


def private_free(df: DataFrame) -> DataFrame:
    return df.drop(*PRIVATE)


def refuse_private(schema: T.StructType, forbidden: tuple[str, ...] = PRIVATE) -> list[str]:
    """Paths of forbidden keys at any depth of a schema; empty if there are none."""
    out: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if f.name in forbidden:
                    out.append(f"{at}{f.name}")
                walk(f.dataType, f"{at}{f.name}.")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, at)

    walk(schema, "")
    return out


def forbidden_json(value: Column, forbidden: tuple[str, ...] = PRIVATE) -> Column:
    """Whether free JSON text holds a forbidden key at any depth; keys within strings are escaped and don't count. Null for null."""
    return value.rlike(r'(?<!\\)"(?:' + "|".join(forbidden) + r')"\s*:')


#: What gives a machine away.
MARKERS = ("/home/", "/mnt/", "/tmp/")


def event_lines(df: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """value and private: each row as JSON without nulls, with whatever isn't a primitive as a string of JSON; private rows hold a
    marker (of a machine, or of rows, such as the beginnings of ids) and may not be shown. A forbidden column is refused."""
    if found := refuse_private(df.schema):
        raise ValueError(f"events may not hold {found}")
    plain = lambda f: F.to_json(f.name) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType | T.NumericType | T.BooleanType) else F.col(f"`{f.name}`").cast("string")
    line = F.to_json(F.struct(*(plain(f).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))))
    return df.select(line.alias("value")).withColumn("private", F.greatest(F.lit(False), *(F.contains("value", F.lit(m)) for m in markers)))


def absolute_paths(df: DataFrame) -> DataFrame:
    """Rows with a string that looks like a path on a machine."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.col(c).rlike(r"(?:^|\s)(?:/(?:home|root|Users|tmp|mnt)/|[A-Z]:\\)"), F.lit(False))
    return df.where(hit)


def write_events(batch: DataFrame, _id: int, path: str) -> None:
    """For foreachBatch: append events as JSON lines; each batch is one folder, so a repeated batch replaces itself."""
    batch.write.mode("overwrite").json(f"{path}/batch={_id}")
