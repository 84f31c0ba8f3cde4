"""Row contracts: ordered rules whose first broken one is the reason, and issue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.tables import materialize

ROLES = ("synthetic_candidate", "selected_training", "synthetic_holdout", "real_calibration_training")
SOURCE_TYPES = ("generated_text", "authentic_text", "licensed_corpus", "public_domain")


def first_broken(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition (broken) holds, or null."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def all_broken(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def unsafe_id(c: Column) -> Column:
    return F.coalesce(~c.rlike(t.SAFE_ID), F.lit(True))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def text_record(role: str, min_words: int = 2, max_words: int = 40, min_characters: int = 6, max_characters: int = 240) -> Column:
    """The first broken rule of a text record of version 2.0, or null. The columns are the record's fields."""
    c = F.col
    spoken, words = c("spoken_text"), F.size(t.tokens(F.coalesce("spoken_text", F.lit(""))))
    clean = lambda x: t.squeezed(t.composed(F.coalesce(x, F.lit("")))) == F.coalesce(x, F.lit("\x00"))
    pair = c("minimal_pair")
    return first_broken(
        ("schema_version", F.coalesce(c("schema_version") != "2.0", F.lit(True))),
        ("candidate_id", unsafe_id(c("candidate_id"))),
        ("language", F.coalesce(c("language") != "sl-SI", F.lit(True))),
        ("partition_role", F.coalesce(c("partition_role") != role, F.lit(True)) | F.lit(role not in ROLES)),
        ("source_type", ~F.coalesce(c("source_type").isin(*SOURCE_TYPES), F.lit(False))),
        ("text_form", ~clean(spoken) | ~clean(c("target_text"))),
        ("text_missing", blank(spoken) | blank(c("target_text"))),
        ("text_differs", spoken != c("target_text")),
        ("word_count", ~words.between(min_words, max_words)),
        ("character_count", ~F.length(spoken).between(min_characters, max_characters)),
        ("markup", spoken.rlike(t.MARKUP)),
        ("symbol", spoken.rlike("[" + "".join(t.FORBIDDEN_SYMBOLS) + "]")),
        ("source_id", unsafe_id(c("source_id"))),
        ("source_family_id", unsafe_id(c("source_family_id"))),
        ("utterance_family_id", unsafe_id(c("utterance_family_id"))),
        ("template_family_id", c("template_family_id").isNotNull() & unsafe_id(c("template_family_id"))),
        ("phenomena", c("phenomena").isNull()),
        ("domain_or_license", blank(c("domain")) | blank(c("license"))),
        ("generation", (c("source_type") == "generated_text") != c("generation").isNotNull()),
        ("entities", F.exists(F.coalesce("entities", F.array()), lambda e: blank(e["surface"]) | blank(e["type"]))),
        ("minimal_pair", pair.isNotNull() & (unsafe_id(pair["family_id"]) | blank(pair["contrast"]))),
    )


def legacy_record(role: str, categories: tuple[str, ...], protected: bool = False, text: str = "target_text", most: int = 240) -> Column:
    """The first broken rule of the older records: id, role, language, text and length, categories; with `protected` also the boolean column is_protected (of a left join to the protected hashes)."""
    c = F.col
    rules = [
        ("candidate_id", unsafe_id(c("candidate_id"))),
        ("partition_role", F.coalesce(c("partition_role") != role, F.lit(True))),
        ("language", F.coalesce(c("language") != "sl-SI", F.lit(True))),
        ("text_missing", blank(c(text))),
        ("length", F.length(c(text)) > most),
        ("markup", c(text).rlike(t.MARKUP)),
        ("phenomena", F.coalesce((F.size("phenomena") < 1) | F.exists("phenomena", lambda p: ~p.isin(*categories)), F.lit(True))),
    ]
    return first_broken(*rules, *([("protected", c("is_protected"))] if protected else []))


def manifest_row(role: str, source_type: str, language: str) -> Column:
    c = F.col
    return first_broken(("role", F.coalesce(c("partition_role") != role, F.lit(True))), ("source_type", F.coalesce(c("source_type") != source_type, F.lit(True))), ("language", F.coalesce((c("lang") != language) | (c("target_lang") != language), F.lit(True))), ("duration", F.coalesce(c("duration") <= 0, F.lit(True))), ("text", blank(c("text"))))


def gate_rows(df: DataFrame, role: str, source_type: str, language: str, order: str) -> DataFrame:
    """df with reason: the first rule that a row of an immutable gate breaks, or null. Of rows with one sample_id or one path (however
    it is written) the first that keeps the other rules stands, later ones repeat it."""
    c = F.col
    rules = first_broken(
        ("role", F.coalesce(c("partition_role") != role, F.lit(True))),
        ("source_type", F.coalesce(c("source_type") != source_type, F.lit(True))),
        ("language", F.coalesce(c("target_lang") != language, F.lit(True))),
        ("sample_id", blank(c("sample_id"))),
    )
    rows = df.withColumns({"__rule": rules, "__path": t.normal_path(c("audio_filepath"))})
    first = lambda by: F.min(F.when(c("__rule").isNull(), c(order))).over(Window.partitionBy(by))
    rows = rows.withColumns({"__first_id": first("sample_id"), "__first_path": first("__path")})
    again = F.when(c("__first_id") < c(order), "duplicate_sample_id").when(c("__first_path") < c(order), "duplicate_audio_filepath")
    return rows.withColumn("reason", F.coalesce("__rule", again)).drop("__rule", "__path", "__first_id", "__first_path")


def eligible_segments(df: DataFrame, excluded: DataFrame, protected: DataFrame, text: str, recording: str, duration: str, least: float, most: float) -> DataFrame:
    """Rows of other recordings, of a fair duration, with text, without unresolved tags, and with none of four hashes protected.

    protected: view (reference, surface or number_masked) and hash. The text's own hash and that of its squeezed form are looked up among references."""
    kept = df.where(F.col(duration).between(least, most) & ~blank(F.col(text)) & ~F.col(text).rlike(r"(?U)(?:#[\w-]+|\(\)[\w-]*)"))
    kept = kept.join(excluded.select(F.col(excluded.columns[0]).alias(recording)).distinct(), recording, "left_anti")
    whole = t.composed(F.col(text))
    surface = t.surface_form(whole)
    views = (("reference", t.fingerprint(whole)), ("reference", t.fingerprint(t.squeezed(whole))), ("surface", t.fingerprint(surface)), ("number_masked", t.fingerprint(t.masked(surface))))
    cells = F.array(*(F.struct(F.lit(view).alias("view"), h.alias("hash")) for view, h in views))
    kept = kept.withColumn("__row", F.monotonically_increasing_id()).withColumn("__cells", cells)
    kept = materialize(kept, "segments")
    hit = kept.select("__row", F.explode("__cells").alias("c")).select("__row", "c.*").join(protected.select("view", "hash").distinct(), ["view", "hash"], "left_semi").select("__row").distinct()
    return kept.join(hit, "__row", "left_anti").drop("__row", "__cells")


def eligible(df: DataFrame, excluded: DataFrame, protected: DataFrame, text: str, recording: str, duration: str, least: float, most: float) -> DataFrame:
    """Rows of other recordings, of a fair duration, with text, without unresolved tags, and not among the protected hashes."""
    kept = df.where(F.col(duration).between(least, most) & ~blank(F.col(text)) & ~F.col(text).rlike(r"(?U)(?:#[\w-]+|\(\)[\w-]*)"))
    kept = kept.join(excluded.select(F.col(excluded.columns[0]).alias(recording)), recording, "left_anti")
    surface = t.surface_form(t.composed(F.col(text)))
    for form in (t.fingerprint(surface), t.fingerprint(t.masked(surface))):
        kept = kept.withColumn("__h", form).join(protected.select(F.col(protected.columns[0]).alias("__h")), "__h", "left_anti").drop("__h")
    return kept


def audio_issues(sample_rate: int = 16_000) -> Column:
    """All broken thresholds of an audio row with its statistics."""
    c = F.col
    return all_broken(
        ("sample_rate", c("rate") != sample_rate),
        ("duration", ~c("duration_seconds").between(0.2, 30.0)),
        ("peak", c("peak") < 0.002),
        ("rms", c("rms") < 0.0005),
        ("active_fraction", c("active_fraction") < 0.02),
        ("clipping", c("clipping_fraction") > 0.01),
        ("leading_silence", c("leading_silence") > 3.0),
        ("trailing_silence", c("trailing_silence") > 3.0),
    )


def log_line(line: Column) -> Column:
    """Whether a child's log line may be shown: progress and stages yes, transcripts and paths no."""
    refused = line.rlike(r"(?i)transcri|reference|hypothes|/home/|\.wav|audio_filepath")
    return F.when(blank(line), "drop").when(refused, "redact").when(line.rlike(r"(?i)epoch|step|loss|stage|progress|\d+%"), "show").otherwise("drop")


def forbidden_rows(df: DataFrame, role: str, forbidden: str = "real_gate") -> DataFrame:
    return df.where(F.col(role) == forbidden)
