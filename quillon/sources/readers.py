"""Readers with explicit schemas: JSON lines, TSV, transcripts, archives, audio, monitor logs, manifests, predictions.

Files are read by Spark, so any store it knows will do. A reader that refuses bad input names the file and the reason."""

from __future__ import annotations

import io
import tarfile
import unicodedata
import wave
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SAFE_ID, SENTINEL
from ..operators.digests import one_digest
from ..operators.ranks import global_rank, order_statistics
from .tables import materialize


class BadInput(ValueError):
    """Input that breaks its contract."""


def refuse(bad: DataFrame, what: str) -> None:
    """Raise if bad has rows; only the first of them travels."""
    if first := bad.limit(1).collect():
        raise BadInput(f"{what}: {first[0].asDict()}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of text files of any size.

    A file is read in splits; a line's number is its place in its split plus the lines of the splits before, a table of a row per
    split. The lines are written once, as a second scan could be split otherwise."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    raw = materialize(raw, "lines")
    counts = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select("file", "split", "first", before.alias("before")), "splits")
    return raw.join(counts, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def _objects(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """raw with row (the line's object) and bad; blank lines are left out."""
    parsed = raw.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema))
    return parsed.withColumn("bad", F.col("row").isNull() | ~F.trim("value").startswith("{") | F.try_parse_json("value").isNull())


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object per line. Blank lines are skipped; a malformed line or another value is refused by file and line (strict) or left out.

    Lines are numbered only for a refusal, so that sound input is read without a shuffle."""
    parsed = _objects(spark.read.text(path), schema)
    if strict and not parsed.where("bad").isEmpty():
        bad = _objects(lines(spark, path), schema).where("bad").orderBy("file", "line")
        refuse(bad.select("file", "line", F.substring("value", 1, 80).alias("starts")), "not a JSON object")
    return parsed.where("not bad").select("row.*")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The columns by name, line (from 2) and issues of a table with a header: `blank_<column>` of required cells that are blank,
    `missing_cells` of rows that are short, `extra_cells` of rows that are long. A missing or repeated column is refused."""
    numbered = lines(spark, path).where("value <> ''")
    head = numbered.where("line = 1").limit(1).collect()
    names = head[0]["value"].split("\t") if head else []
    if missing := [c for c in required if c not in names]:
        raise BadInput(f"columns are missing: {missing}")
    if len(set(names)) < len(names):
        raise BadInput(f"columns are repeated: {sorted({c for c in names if names.count(c) > 1})}")
    cells = F.when(F.col("line") > 1, F.split("value", "\t", -1))  # a later filter may come first, and the header's cells aren't values
    rows = numbered.where("line > 1").select("line", F.size(cells).alias("__cells"), *(F.try_element_at(cells, F.lit(i + 1)).alias(c) for i, c in enumerate(names)))
    shape = [F.when(F.col("__cells") < len(names), F.lit("missing_cells")), F.when(F.col("__cells") > len(names), F.lit("extra_cells"))]
    blank = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"blank_{c}")) for c in required]
    return rows.withColumn("issues", F.array_compact(F.array(*blank, *shape))).drop("__cells")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


SEGMENTS = "file string, recording string, turn int, place int, start double, `end` double, text string, problem string"


def transcript_segments(spark: SparkSession, path: str, mode: str = "", collection: str = "", forbidden: str = "") -> DataFrame:
    """file, recording, sample_id, place, start, end and text of XML transcripts, of all folders below: the text after a Sync runs to the next Sync of its Turn.

    A path has to hold `mode` and `collection`, and may not hold `forbidden` (none by default), whatever the case. A file that isn't
    XML, a Sync without a time, intervals that are empty or overlap and ids that aren't safe are refused by file; turns with fewer
    than two marks and blank texts are left out. Texts are in NFC, white space squeezed. A transcript is parsed in one task, by an XML parser."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")
    at = F.lower("file")
    wrong = F.when(F.lit(bool(forbidden)) & at.contains(forbidden.lower()), "a transcript of a forbidden kind").when(~at.contains(mode.lower()), f"not a {mode} transcript").when(~at.contains(collection.lower()), f"not of {collection}")
    refuse(found.select("file", wrong.alias("problem")).where("problem is not null"), "transcripts")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *segment) for file, content in zip(batch["file"], batch["content"], strict=True) for segment in _segments(file, content)]
            yield pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in SEGMENTS.split(", ")])

    cut = materialize(found.mapInPandas(parse, SEGMENTS), "segments")
    refuse(cut.where("problem is not null").orderBy("file").select("file", "problem", "start", "end"), "transcripts")
    name = F.lower(F.concat_ws("-", F.lit("recording"), "recording", F.lpad(F.col("turn").cast("string"), 4, "0"), F.lpad(F.col("place").cast("string"), 4, "0")))
    cut = cut.withColumn("sample_id", F.regexp_replace(F.regexp_replace(name, "[^a-z0-9._-]+", "-"), "^-+|-+$", ""))
    refuse(cut.where(~F.col("sample_id").rlike(SAFE_ID)).select("file", "sample_id"), "ids aren't safe")
    order = Window.partitionBy("file").orderBy("turn", "place")
    return cut.select("file", "recording", "sample_id", (F.row_number().over(order) - 1).alias("place"), "start", "end", "text")


def _segments(file: str, content: bytes) -> Iterator[tuple]:
    """recording, turn, place, start, end, text and problem of one transcript."""
    recording = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        yield recording, None, None, None, None, None, f"not XML: {e}"
        return
    last = float("-inf")
    for turn, spoken in enumerate(root.iter("Turn")):
        marks = [(s.get("time"), s.tail or "") for s in spoken.iter("Sync")]
        if len(marks) < 2:
            continue
        try:
            times = [float(t) for t, _ in marks]
        except (TypeError, ValueError):
            yield recording, turn, None, None, None, None, "a Sync without a time"
            return
        for place, (start, end, (_, text)) in enumerate(zip(times, times[1:], marks, strict=False)):
            text = unicodedata.normalize("NFC", " ".join(text.split()))
            if text:
                problem = "an interval is empty" if end <= start else "intervals overlap" if start < last else None
                yield recording, turn, place, start, end, text, problem
                last = end


def archive_stems(spark: SparkSession, path: str) -> DataFrame:
    """file and stem of the audio members of tar archives; archives with absolute, climbing or link members are refused."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        unsafe = m.name.startswith("/") or ".." in m.name.split("/") or m.issym() or m.islnk()
                        if unsafe or m.name.endswith(".wav"):
                            rows.append((file, m.name.rsplit("/", 1)[-1].removesuffix(".wav"), unsafe))
            yield pd.DataFrame(rows, columns=["file", "stem", "unsafe"])

    members = materialize(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, stem string, unsafe boolean"), "members")
    refuse(members.where("unsafe"), "unsafe archive member")
    return members.select("file", "stem").distinct()


WAV_DDL = "file string, channels int, rate int, width int, frames long, seconds double, samples array<short>"


def wav(spark: SparkSession, path: str) -> DataFrame:
    """Header and samples of 16-bit WAV files; other files are refused."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as f:
                        n, rate = f.getnframes(), f.getframerate()
                        rows.append((file, f.getnchannels(), rate, f.getsampwidth(), n, n / rate, np.frombuffer(f.readframes(n), "<i2")))
                except (wave.Error, EOFError, ValueError):
                    rows.append((file, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["file", "channels", "rate", "width", "frames", "seconds", "samples"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(read, WAV_DDL)
    found = materialize(found, "samples")  # decoded once, for the refusal and for what follows
    refuse(found.where("rate is null").select("file"), "not a WAV file")
    return found


def monitor(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, utilization, memory, power of monitor logs; rows with cells that are missing or not numbers are left out."""
    raw = spark.read.option("header", True).schema("timestamp string, `index` string, name string, memory_used_mib string, utilization_percent string, power_watts string").csv(path)
    rows = raw.select("timestamp", *(F.trim(c).try_cast("double").alias(a) for c, a in (("utilization_percent", "utilization"), ("memory_used_mib", "memory"), ("power_watts", "power"))))
    return rows.where("utilization is not null and memory is not null and power is not null")


def monitor_summary(rows: DataFrame) -> DataFrame:
    """samples, peaks, means, the share of busy samples and p95 = sorted[min(n - 1, floor(0.95 n))]; zeros when there are none."""
    rows = rows.withColumn("__all", F.lit(0))
    p95 = order_statistics(rows, "__all", "utilization", F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))
    out = rows.agg(F.count(F.lit(1)).alias("samples"), F.max("memory").alias("peak_memory"), F.avg("utilization").alias("mean_utilization"), F.avg((F.col("utilization") >= 80).cast("double")).alias("busy_fraction"), F.max("power").alias("peak_power"))
    out = out.join(F.broadcast(p95.select(F.col("value").alias("p95_utilization"))), F.lit(True), "left")  # a row each
    return out.select("samples", "peak_memory", "mean_utilization", "busy_fraction", "p95_utilization", "peak_power").fillna(0)


def verified_manifest(spark: SparkSession, path: str, schema: T.StructType, rows: int, unique: tuple[str, ...], rule: str, sha256: str | None = None) -> DataFrame:
    """A JSON-lines manifest with this checksum (of its file), so many rows, unique keys, and whose rows all satisfy the rule (an expression)."""
    if sha256 is not None and [r["sha256"] for r in file_hashes(spark, path).limit(2).collect()] != [sha256]:
        raise BadInput(f"{path} doesn't have the checksum {sha256}")
    df = jsonl(spark, path, schema)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.expr(rule), 0).otherwise(1)).alias("broken"), *(F.count_distinct(c).alias(c) for c in unique)).first()
    if seen["n"] != rows or seen["broken"] or any(seen[c] != rows for c in unique):
        raise BadInput(f"the manifest doesn't keep its contract: {seen.asDict()}")
    return df


def hashes_of(df: DataFrame, lists: list[str]) -> DataFrame:
    """Distinct values of several array columns."""
    found = None
    for c in lists:
        one = df.select(F.explode(c).alias("hash"))
        found = one if found is None else found.unionAll(one)
    return found.distinct()


def candidates(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of model output that is a JSON list or an object with candidates, without Markdown: exploded; others give one row with error."""
    t = F.trim(text)
    listed = F.coalesce(F.from_json(F.when(t.startswith("["), t), f"array<{schema}>"), F.from_json(F.when(t.startswith("{"), t), f"candidates array<{schema}>")["candidates"])
    listed = F.when(t.contains("```"), None).otherwise(listed)
    return df.withColumn("__c", listed).withColumn("error", F.when(F.col("__c").isNull(), "not_strict_json")).select(*df.columns, "error", F.explode_outer("__c").alias("candidate"))


def sentinel_predictions(df: DataFrame, text: str) -> DataFrame:
    """sample_id and hypothesis from texts with a sentinel prefix; malformed ones and repeated ids are refused."""
    out = df.select(F.nullif(F.regexp_extract(text, rf"(?s)^{SENTINEL}([^\t]+)\t(.*)$", 1), F.lit("")).alias("sample_id"), F.regexp_extract(text, rf"(?s)^{SENTINEL}[^\t]+\t(.*)$", 1).alias("hypothesis"))
    refuse(out.where("sample_id is null"), "malformed sentinel")
    refuse(out.groupBy("sample_id").count().where("count > 1"), "repeated id")
    return out


def ordered_predictions(predictions: DataFrame, records: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Predictions and records side by side by their places; their numbers have to be equal."""
    if predictions.count() != records.count():
        raise BadInput("predictions and records differ in number")
    return global_rank(predictions, left_order, name="__pos").join(global_rank(records, right_order, name="__pos"), "__pos").drop("__pos")


def availability(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """round and available for rounds 0 to `last`, by files named *round<NN>*."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"round0*(\d+)", 1).try_cast("long").alias("round")).distinct()
    return spark.range(last + 1).withColumnRenamed("id", "round").join(files.withColumn("available", F.lit(True)), "round", "left").fillna(False, ["available"])


def newest(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    row = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime").agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row["p"]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and md5 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def tree_hash(hashes: DataFrame, root: str) -> str:
    """One hash for a folder: of its sorted lines of relative path and hash."""
    return one_digest(hashes.select(F.concat(F.substring_index("path", root, -1), F.lit(" "), F.col("sha256")).alias("line")), "line")
