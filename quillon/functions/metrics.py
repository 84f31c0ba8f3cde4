"""Edit distances, error rates, buckets and percentiles as column expressions.

Distances between word lists are taken by the built-in levenshtein after each distinct word of the pair has been
recoded to one character, so they stay in the JVM. Counts of substitutions, deletions and insertions need more than the
distance and come from one Arrow function, which fills the tables of many pairs side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens

EDITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")])


def words_of(text: Column) -> Column:
    return tokens(F.coalesce(text, F.lit("")))


def _recoded(words: Column, known: Column) -> Column:
    """One character per word: the word's place in `known`, from U+4E00, past the surrogates."""
    place = lambda w: F.array_position(known, w) + 0x4E00
    point = lambda w: F.when(place(w) < 0xD800, place(w)).otherwise(place(w) + 0x0800)
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(point(w)), 8, "0")), "UTF-32")), "")


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: as a lambda's variable it isn't copied into the expressions that use it."""
    return F.transform(F.array(value), use)[0]


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance between two arrays of words."""
    pair = F.struct(reference.alias("r"), hypothesis.alias("h"))
    return bound(pair, lambda p: bound(F.array_distinct(F.concat(p["r"], p["h"])), lambda known: F.levenshtein(_recoded(p["r"], known), _recoded(p["h"], known))))


def percent(distance: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, distance / denominator * 100.0).when(distance == 0, 0.0).otherwise(100.0)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    scored = bound(F.struct(words_of(reference).alias("r"), words_of(hypothesis).alias("h")), lambda p: F.struct(word_distance(p["r"], p["h"]).alias("d"), F.size(p["r"]).alias("n")))
    return bound(scored, lambda x: percent(x["d"], x["n"]))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """On all characters, spaces too."""
    return percent(F.levenshtein(F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))), F.length(F.coalesce(reference, F.lit(""))))


def edits(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of the cheapest alignment; of equal costs the one with the fewest insertions.

    One number holds cost and insertions: an insertion costs `unit` + 1, the others `unit`, with unit above all lengths."""
    n, m = len(reference), len(hypothesis)
    unit = n + m + 1
    codes: dict = {}
    r = np.array([codes.setdefault(x, len(codes)) for x in reference], dtype=np.int64)
    h = np.array([codes.setdefault(x, len(codes)) for x in hypothesis], dtype=np.int64)
    steps = np.arange(m + 1, dtype=np.int64) * (unit + 1)
    row = steps.copy()
    for i in range(n):
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = row[0] + unit
        np.minimum(row[1:] + unit, row[:-1] + np.where(h == r[i], 0, unit), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps  # insertions to the right
    cost, insertions = divmod(int(row[m]), unit)
    deletions = insertions + n - m
    return cost - insertions - deletions, deletions, insertions


#: Cells of a row of the tables of edits that are filled together.
CELLS = 200_000


def _table(side: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of codes as the rows of one matrix, and their lengths."""
    sizes = np.array([len(x) for x in side], dtype=np.int64)
    out = np.full((len(side), sizes.max(initial=0)), fill, dtype=np.int64)
    for k, x in enumerate(side):
        out[k, : len(x)] = x
    return out, sizes


def edits_of_pairs(references: list[np.ndarray], hypotheses: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """`edits` of many pairs of sequences of codes (from 0), a row each; pairs of like lengths go through the table together."""
    out = np.zeros((len(references), 3), dtype=np.int64)
    order = sorted(range(len(references)), key=lambda k: (len(references[k]), len(hypotheses[k])))
    start = 0
    while start < len(order):
        end, widest = start, 0
        while end < len(order) and (end == start or (end - start + 1) * (max(widest, len(hypotheses[order[end]])) + 1) <= cells):
            widest = max(widest, len(hypotheses[order[end]]))
            end += 1
        some = order[start:end]
        (r, n), (h, m) = _table([references[k] for k in some], -1), _table([hypotheses[k] for k in some], -2)
        unit = (n + m + 1)[:, None]
        steps = np.arange(h.shape[1] + 1, dtype=np.int64) * (unit + 1)
        row, found = steps, np.take_along_axis(steps, m[:, None], 1)[:, 0]
        for i in range(r.shape[1]):
            best = row + unit
            np.minimum(best[:, 1:], row[:, :-1] + np.where(h == r[:, i : i + 1], 0, unit), out=best[:, 1:])
            row = np.minimum.accumulate(best - steps, axis=1) + steps  # insertions to the right
            ends = np.flatnonzero(n == i + 1)
            found[ends] = row[ends, m[ends]]
        cost, insertions = np.divmod(found, unit[:, 0])
        deletions = insertions + n - m
        out[some] = np.stack([cost - insertions - deletions, deletions, insertions], axis=1)
        start = end
    return out


def _edit_counts(reference: pd.Series, hypothesis: pd.Series, codes_of) -> pd.DataFrame:
    """Equal pairs of a batch are scored once."""
    known: dict[tuple[str, str], int] = {}
    at = [known.setdefault((r or "", h or ""), len(known)) for r, h in zip(reference, hypothesis, strict=True)]
    found = edits_of_pairs([codes_of(r) for r, _ in known], [codes_of(h) for _, h in known])
    return pd.DataFrame(found[np.array(at, dtype=np.int64)], columns=["substitutions", "deletions", "insertions"])


@F.pandas_udf(EDITS)
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Of two texts, by words."""
    codes: dict[str, int] = {}
    return _edit_counts(reference, hypothesis, lambda text: np.array([codes.setdefault(w, len(codes)) for w in text.split()], dtype=np.int64))


@F.pandas_udf(EDITS)
def character_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return _edit_counts(reference, hypothesis, lambda text: np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64))


def is_empty(hypothesis: Column) -> Column:
    return F.trim(F.coalesce(hypothesis, F.lit(""))) == ""


def empty_status(hypothesis: Column) -> Column:
    return F.when(is_empty(hypothesis), "EMPTY_HYPOTHESIS").otherwise("NONEMPTY")


def recognition_change(reference: Column, base: Column, adapted: Column) -> Column:
    rates = F.struct(word_error_rate(reference, base).alias("before"), word_error_rate(reference, adapted).alias("after"))
    change = bound(rates, lambda x: F.when(x["after"] < x["before"], "IMPROVED").when(x["after"] > x["before"], "REGRESSED").otherwise("UNCHANGED"))
    return F.when(is_empty(adapted), "EMPTY_HYPOTHESIS").when(adapted == reference, "EXACT_MATCH").otherwise(change)


def relative_improvement(base: Column, challenger: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise((base - challenger) / base * 100.0)


def error_bucket(value: Column) -> Column:
    return F.when(value == 0, "0").when(value <= 25, "0-25").when(value <= 50, "25-50").when(value <= 75, "50-75").when(value <= 100, "75-100").otherwise("over-100")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 2.0, "short_lt_2s").when(seconds <= 5.0, "medium_2_to_5s").otherwise("long_gt_5s")


def hard_score(empty: Column, wer: Column, cer: Column) -> Column:
    return F.when(empty, 1000.0).otherwise(0.0) + wer + 0.25 * cer


def perplexity(loss: Column) -> Column:
    return F.round(F.exp(F.least(loss, F.lit(50.0))), 6)


def decibels(value: Column, reference: Column) -> Column:
    return 20 * F.log10(value / reference)


def rounded(value: Column, digits: int) -> Column:
    """Half to even on the decimal form, as float formatting does."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def unit_interval(*parts: Column) -> Column:
    """The first 12 hex digits of the parts' hash as a number from 0 to 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("long") / F.lit(float(0xFFFFFFFFFFFF))


def seed_31(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("long") % F.lit(2**31 - 1)


def seed_32(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def chosen(options: Column, *parts: Column) -> Column:
    return F.element_at(options, (seed_32(*parts) % F.size(options) + 1).cast("int"))


def chunk_seconds(context: Column) -> Column:
    """Seconds of audio a streaming context [left, right] advances by: (right + 1) frames of 80 ms."""
    return (context[1] + 1) * 0.08
