"""Statistics and transforms of 16-bit samples, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Silence is at most 32 of 32768, clipping from 32760.
SILENT, CLIPPED = 32, 32760
STATS = "peak double, rms double, active_fraction double, clipping_fraction double, leading_silence double, trailing_silence double, duration_seconds double, audio_sha256 string"


def stats(samples: np.ndarray, rate: int) -> tuple:
    x = np.abs(samples.astype(np.int32))
    if not len(x):
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, hashlib.sha256(b"").hexdigest()
    active = np.flatnonzero(x > SILENT)
    lead = active[0] if len(active) else len(x)
    trail = len(x) - 1 - active[-1] if len(active) else len(x)
    rms = float(np.sqrt(np.mean((samples / 32768.0) ** 2)))
    return float(x.max() / 32768), rms, len(active) / len(x), float((x >= CLIPPED).mean()), lead / rate, trail / rate, len(x) / rate, hashlib.sha256(samples.astype("<i2").tobytes()).hexdigest()


def audio_stats(df: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """df without the samples, with their statistics."""
    keep = [c for c in df.columns if c != samples]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [stats(np.asarray(s, dtype=np.int16), r) for s, r in zip(b[samples], b[rate], strict=True)]
            names = [x.split()[0] for x in STATS.split(", ")]
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), STATS])
    return df.mapInPandas(run, ddl)


def _noise(x, p, rng):
    level = np.sqrt(np.mean(x**2)) / 10 ** (p["snr_db"] / 20)
    return x + rng.normal(scale=level or 1e-9, size=len(x))


def _band(x, p, rng):
    f = np.fft.rfftfreq(len(x), 1 / p.get("rate", 16000))
    s = np.fft.rfft(x)
    s[(f < p.get("low", 0)) | (f > p.get("high", 1e9))] = 0
    return np.fft.irfft(s, len(x))


@lru_cache(maxsize=64)
def _low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc at the lower of both rates, ten zero crossings to a side, under a Kaiser window of 5."""
    most = max(up, down)
    half = 10 * most
    h = np.sinc((np.arange(2 * half + 1) - half) / most) * np.kaiser(2 * half + 1, 5.0)
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate, ceil(n * up / down) samples: the filter runs over samples spread by `up`, of which every
    `down`-th is wanted, so each result takes one phase of the filter, and neither zeros nor dropped samples are computed."""
    common = gcd(up, down)
    up, down = up // common, down // common
    if up == down or not len(x):
        return x.astype(np.float64)
    h = _low_pass(up, down)
    half = len(h) // 2
    n = -(-len(x) * up // down)
    at = np.arange(n, dtype=np.int64) * down + half  # in the spread samples
    taps = -(-len(h) // up)
    held = np.concatenate([np.zeros(taps), x, np.zeros(half // up + 2)])
    phases = np.zeros((up, taps))
    for p in range(up):
        phases[p, : len(h[p::up])] = h[p::up]
    out = np.empty(n)
    for i in range(0, n, 65_536):  # bounded memory for long recordings
        t = at[i : i + 65_536]
        window = held[(t // up + taps)[:, None] - np.arange(taps)[None, :]]
        out[i : i + 65_536] = np.einsum("ij,ij->i", window, phases[t % up])
    return out


def _resampled(x, p, rng):
    """Read at another speed, given as up / down or as a factor."""
    rate = Fraction(p["up"], p["down"]) if "up" in p else 1 / Fraction(p["factor"]).limit_denominator(1000)
    return resample(x, rate.numerator, rate.denominator)


def _room(x, p, rng):
    n = int(p.get("rate", 16000) * p["seconds"])
    echo = rng.normal(size=n) * np.exp(-6.9 * np.arange(n) / n)
    echo[0] = 5.0
    return np.convolve(x, echo / np.abs(echo).sum())[: len(x)]


def _codec(x, p, rng):
    """Mu-law to `bits` bits and back."""
    mu = 2 ** p["bits"] - 1
    y = np.sign(x) * np.log1p(mu * np.abs(x)) / np.log1p(mu)
    y = np.round(y * mu / 2) / (mu / 2)
    return np.sign(y) * np.expm1(np.abs(y) * np.log1p(mu)) / mu


#: Transforms of samples between -1 and 1.
PROFILES: dict[str, Callable] = {
    "clean": lambda x, p, rng: x,
    "noise": _noise,
    "hum": lambda x, p, rng: x + p["level"] * np.sin(2 * np.pi * p["hertz"] * np.arange(len(x)) / p.get("rate", 16000)),
    "band": _band,
    "speed": _resampled,
    "room": _room,
    "codec": _codec,
    "gain": lambda x, p, rng: x * 10 ** (p["db"] / 20),
    "shift": lambda x, p, rng: np.concatenate([np.zeros(int(p["seconds"] * p.get("rate", 16000))), x]),
    "clip": lambda x, p, rng: np.clip(x, -p["level"], p["level"]),
    "tilt": lambda x, p, rng: np.append(x[:1], x[1:] - p["amount"] * x[:-1]),
}


def transform(samples: np.ndarray, profile: str, parameters: dict, seed: str, peak: float = 0.95) -> np.ndarray:
    """The profile's result with the source's loudness, at most `peak`; the same seed gives the same samples."""
    x = samples / 32768.0
    rng = np.random.default_rng(int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16))
    y = PROFILES[profile](x, parameters, rng)
    loud = lambda s: float(np.sqrt(np.mean(s**2))) if len(s) else 0.0
    if profile != "gain" and loud(y):
        y = y * loud(x) / loud(y)
    top = float(np.abs(y).max()) if len(y) else 0.0
    y = y * min(1.0, peak / top) if top else y
    return np.round(np.clip(y, -1, 32767 / 32768) * 32768).astype(np.int16)


def augment(df: DataFrame, profile: str, parameters: dict, key: str, samples: str = "samples") -> DataFrame:
    """df with its samples transformed; each row's seed is its key and the profile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[samples] = [transform(np.asarray(s, dtype=np.int16), profile, parameters, f"{k}:{profile}") for k, s in zip(b[key], b[samples], strict=True)]
            yield b

    return df.mapInPandas(run, df.schema)


#: Least and most of an audio row's statistics.
DURATION, PEAK, RMS, ACTIVE, CLIPPING, SILENCE = (0.2, 30.0), 0.002, 0.0005, 0.02, 0.01, 3.0
LINKED = ("source_id", "source_family_id", "utterance_family_id")


def _reasons(rows: DataFrame, rules: list[tuple[Column, str]], *keep: str) -> DataFrame:
    """keep and reason for every rule that holds for a row."""
    judged = rows.select(*keep, *(F.when(rule, F.lit(reason)).alias(f"__{i}") for i, (rule, reason) in enumerate(rules)))
    return judged.select(*keep, F.explode(F.array_compact(F.array(*(f"__{i}" for i in range(len(rules)))))).alias("reason"))


def manifest_issues(manifest: DataFrame, accepted: DataFrame, audio: DataFrame, channels: int = 1, rate: int = 16_000, width: int = 2) -> DataFrame:
    """candidate_id and reason for whatever an audio manifest gets wrong; empty for a sound one.

    manifest: candidate_id, audio_filepath, text, text_sha256 and the linked fields, in the order of `position`; accepted:
    candidate_id, target_text and the linked fields; audio: file, channels, rate, width (null if malformed) and the statistics.
    The first row of an id, a path or a recording stands, later ones are duplicates; rows of unknown ids are not looked at further,
    and rows without a readable file not at what it holds. Accepted items without a row are missing."""
    wanted = accepted.select(F.col("candidate_id").alias("__id"), F.col("target_text").alias("__text"), *(F.col(c).alias(f"__{c}") for c in LINKED))
    heard = audio.select(F.col("file").alias("__file"), *(F.col(c).alias(f"__{c}") for c in ("channels", "rate", "width", "duration_seconds", "peak", "rms", "active_fraction", "clipping_fraction", "leading_silence", "trailing_silence", "audio_sha256")))
    rows = manifest.join(wanted, F.col("candidate_id") == F.col("__id"), "left").join(heard, F.col("audio_filepath") == F.col("__file"), "left")
    again = lambda c, among: among & (F.min(F.when(among, F.col("position"))).over(Window.partitionBy(c)) < F.col("position"))
    known, there = F.col("__id").isNotNull(), F.col("__file").isNotNull()
    sound = known & there & F.col("__rate").isNotNull()
    c = F.col
    rules = [
        (~known, "unexpected_item"),
        (again("candidate_id", known), "duplicate_candidate_id"),
        (again("audio_filepath", known), "duplicate_audio_path"),
        (known & ~there, "missing_audio"),
        (known & there & c("__rate").isNull(), "malformed_audio"),
        (sound & ~(c("text").eqNullSafe(c("__text")) & c("text_sha256").eqNullSafe(F.sha2("__text", 256))), "transcript_linkage_mismatch"),
        *((sound & ~c(x).eqNullSafe(c(f"__{x}")), f"{x}_mismatch") for x in LINKED),
        (again("__audio_sha256", sound), "duplicate_audio_sha256"),
        (sound & (c("__channels") != channels), "wrong_channels"),
        (sound & (c("__rate") != rate), "wrong_sample_rate"),
        (sound & (c("__width") != width), "wrong_sample_width"),
        (sound & ~c("__duration_seconds").between(*DURATION), "duration_out_of_bounds"),
        (sound & (c("__peak") < PEAK), "low_peak"),
        (sound & (c("__rms") < RMS), "low_rms"),
        (sound & (c("__active_fraction") < ACTIVE), "low_active_fraction"),
        (sound & (c("__clipping_fraction") > CLIPPING), "clipping"),
        (sound & (c("__leading_silence") > SILENCE), "leading_silence"),
        (sound & (c("__trailing_silence") > SILENCE), "trailing_silence"),
    ]
    found = _reasons(rows, rules, "candidate_id")
    missing = accepted.select("candidate_id").join(manifest.select("candidate_id"), "candidate_id", "left_anti")
    return found.unionAll(missing.select("candidate_id", F.lit("missing_item")))


def augmentation_issues(rows: DataFrame, sources: DataFrame, profiles: list[str], ratio_tolerance: float = 0.02, rms_tolerance_db: float = 0.5, most_peak: float = 0.99, plain: str = "clean") -> DataFrame:
    """source_id, profile_id and reason of augmented recordings outside their tolerances, and of sources without every profile once.

    rows: source_id, profile_id, path, expected_ratio and observed_ratio (of durations), source_rms, output_rms, peak,
    peak_gain (under 1 where the peak was held down, so that loudness can't match), clipping_fraction, active_fraction, audio_sha256."""
    c = F.col
    changed = c("profile_id") != plain
    loudness = F.when((c("output_rms") > 0) & (c("source_rms") > 0), 20 * F.log10(c("output_rms") / c("source_rms"))).otherwise(0.0)
    same = lambda by, among: among & (F.count(F.when(among, 1)).over(Window.partitionBy(by)) > 1)
    known = sources.select("source_id").distinct().withColumn("__known", F.lit(True))
    rules = [
        (c("__known").isNull(), "unknown_source"),
        (~c("profile_id").isin(profiles), "unknown_profile"),
        (c("clipping_fraction") > CLIPPING, "clipping_fraction"),
        (c("active_fraction") < ACTIVE, "active_fraction"),
        (changed & (c("peak") > most_peak), "peak_limit"),
        (changed & (F.abs(c("observed_ratio") - c("expected_ratio")) > ratio_tolerance), "duration_ratio"),
        (changed & (c("peak_gain") >= 0.999999) & (F.abs(loudness) > rms_tolerance_db), "rms_match"),
        (same("path", F.lit(True)), "duplicate_output_path"),
        (same("audio_sha256", changed), "duplicate_hash"),
    ]
    found = _reasons(rows.join(known, "source_id", "left"), rules, "source_id", "profile_id")
    every = known.select("source_id", F.explode(F.array(*(F.lit(p) for p in profiles))).alias("profile_id"))
    held = rows.groupBy("source_id", "profile_id").agg(F.count(F.lit(1)).alias("n"))
    short = every.join(held, ["source_id", "profile_id"], "left").where("coalesce(n, 0) <> 1")
    return found.unionAll(short.select("source_id", "profile_id", F.lit("not_once_for_source")))


def voice_coverage(df: DataFrame, voices: DataFrame, voice: str, least: int = 1) -> DataFrame:
    """voice and n of the voices with fewer than `least` rows."""
    counts = df.groupBy(voice).agg(F.count(F.lit(1)).alias("n"))
    return voices.select(voice).distinct().join(counts, voice, "left").select(voice, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def voice_report(df: DataFrame, voice: str) -> DataFrame:
    """count, least, mean, median, p95 and most duration by voice."""
    s = F.col("duration_seconds")
    return df.groupBy(voice).agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.expr("median(duration_seconds)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_seconds)").alias("p95"), F.max(s).alias("most"))
