"""Text forms, fingerprints and n-grams as column expressions.

All run in the JVM. Spark has no Unicode composition, so `composed` sends the few texts that may need it (any code point
from U+0300 on) through one Arrow function and leaves the others alone."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the text contract. \b, \w and \s are Unicode-aware by (?U).
#: What Python's \w holds: letters, all numbers and the underscore; no marks, no other connectors.
WORD = r"\p{L}\p{N}_"
NUMBER_MASKS = (
    (r"(?U)\b\d{1,2}\.\s*\d{1,2}\.\s*\d{2,4}\b", "<DATE>"),
    (r"(?U)\b\d{1,2}[:.]\d{2}\b", "<TIME>"),
    (r"(?iU)\b\d+(?:[,.]\d+)?\s*(?:kg|g|km|m|cm|mm|l|ml|%)\b", "<QUANTITY>"),
    (r"(?U)\b\d+(?:[.,:/-]\d+)*\b", "<NUM>"),
)
METADATA = (
    r"(?iU)\b(?:candidate|row|group|batch|sample|skupina|vrstica|kandidat|vzorec)\s*[-_.:#]*\s*[a-z]*\d+\b",
    r"(?iU)\bid\s*[-_.:#]*\s*\d+\b",
)
METADATA_WORDS = ("candidate", "row", "group", "batch", "sample", "station", "skupina", "vrstica", "kandidat", "vzorec")
PROHIBITED = (
    r"(?iU)\bskupina\s+<NUM>\s+pove\s+da\b",
    r"(?iU)\bpri\s+postaji\s+<NUM>\s+pri\s+postaji\s+<NUM>\b",
    r"(?iU)\b(?:candidate|row|group|batch|sample)\s+<NUM>\b",
)
MARKUP = r"https?://|www\.|```|<[^>]+>"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LIST_MARK = r"^\s*(?:\d{1,4}[).:\-]\s*|[-*•]\s*)"
NOISY_LINE = r"(?i)^\s*(?:json|candidates?|sentences?|stavki?|output|response)\s*:?\s*$"
NUMBERED = r"^(?:\d{1,4}[).:\-]\s+|[-*•]\s+)"
HEADING = r"\s*(?:stavki|odgovor|output|sentences?|kandidati|candidate|json|slovenian|slovenščina)\s*:?\s*"
BRACKETED = r"^\s*(?:[\[{}`]|#+\s+)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-ZČŠŽ])"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{1,127}$"
FORBIDDEN_SYMBOLS = ("€", "°")


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _bare_letters(texts: pd.Series) -> pd.Series:
    """Decomposed, without combining marks."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def composed(text: Column) -> Column:
    """NFC. Texts without code points from U+0300 on are in NFC already and stay in the JVM."""
    return F.coalesce(_nfc(F.when((F.octet_length(text) != F.length(text)) & text.rlike("[^\\x{0}-\\x{2FF}]"), text)), text)


def bare_letters(text: Column) -> Column:
    return F.coalesce(_bare_letters(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def folded(text: Column) -> Column:
    """Case-folded: lower case but for letters such as ß that fold to several."""
    return F.coalesce(_folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def squeezed(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def surface_form(text: Column) -> Column:
    """Lower case, each run of anything but word characters (apostrophes and hyphens too) one space, trimmed. Give it composed text."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{WORD}]+", " "))


def masked(surface: Column) -> Column:
    """Dates, times, quantities and numbers by their marks. Texts without a digit hold none of them."""
    marked = surface
    for pattern, mark in NUMBER_MASKS:
        marked = F.regexp_replace(marked, pattern, mark)
    return squeezed(F.when(surface.rlike(r"\p{Nd}"), marked).otherwise(surface))


def number_masked(text: Column) -> Column:
    return masked(surface_form(text))


def entity_masked(text: Column, entities: Column) -> Column:
    """entities: array<struct<surface, type>>; the longest surfaces are replaced first."""
    named = F.transform(F.coalesce(entities, F.array()), lambda e: F.struct((-F.length(surface_form(e["surface"]))).alias("n"), surface_form(e["surface"]).alias("surface"), F.coalesce(F.nullif(F.upper(F.trim(e["type"])), F.lit("")), F.lit("ENTITY")).alias("type")))
    ordered = F.array_sort(F.filter(named, lambda e: e["surface"] != ""))
    replace = lambda done, e: F.regexp_replace(done, F.concat(F.lit(r"(?iU)\b\Q"), e["surface"], F.lit(r"\E\b")), F.concat(F.lit("<"), e["type"], F.lit(">")))
    return masked(F.aggregate(ordered, number_masked(text), replace))


def tokens(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != "")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_hash(text: Column) -> Column:
    return F.sha2(composed(text), 256)


def template_family(form: Column) -> Column:
    return F.concat(F.lit("dtf-"), F.substring(fingerprint(form), 1, 16))


def n_grams(words: Column, n: int, separator: str = " ") -> Column:
    """All runs of n words, in order and with repeats; none if there are fewer.

    Shifted arrays side by side: a lambda that looked into the whole array would evaluate it for each place."""
    size = F.size(words) - (n - 1)
    shifted = F.arrays_zip(*(F.slice(words, i + 1, size) for i in range(n)))
    joined = F.transform(shifted, lambda x: F.concat_ws(separator, *(x.getField(str(i)) for i in range(n))))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def token_shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; the whole text if it is shorter, none if it is blank."""
    short = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, F.array_distinct(n_grams(words, n))).otherwise(short)


def hashed_shingles(words: Column, n: int) -> Column:
    """token_shingles by 64-bit hashes of the word runs, with repeats; made without joining words. n is 5 at most."""
    size = F.size(words) - (n - 1)
    shifted = F.arrays_zip(*(F.slice(words, i + 1, size) for i in range(n)))
    runs = F.transform(shifted, lambda x: F.xxhash64(*(x.getField(str(i)) for i in range(n))))
    short = F.array().cast("array<bigint>")
    for k in range(1, n):
        short = F.when(F.size(words) == k, F.array(F.xxhash64(*(words[i] for i in range(k))))).otherwise(short)
    return F.when(F.size(words) >= n, runs).otherwise(short)


def _tagged(tag: str, runs: Column) -> Column:
    return F.transform(runs, lambda g: F.concat(F.lit(tag), g))


def tagged_features(words: Column) -> Column:
    """Runs of 2 to 6 words with their place: p opens the text, s closes it, i stands anywhere, f is an opening with a closing that
    don't overlap; with repeats for inner runs. Each is tagged by kind and width, as in `p2:`."""
    run = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    parts = []
    for n in range(2, 7):
        head, tail = run(1, n), run(-n, n)
        ends = F.array(F.concat(F.lit(f"p{n}:"), head), F.concat(F.lit(f"s{n}:"), tail), F.when(F.size(words) >= 2 * n, F.concat(F.lit(f"f{n}:"), head, F.lit("||"), tail)))
        parts += [F.when(F.size(words) >= n, F.array_compact(ends)).otherwise(F.array().cast("array<string>")), _tagged(f"i{n}:", n_grams(words, n))]
    return F.concat(*parts)


def character_shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n characters of the text without spaces."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    short = F.when(F.length(compact) > 0, F.array(compact)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(compact) >= n, F.array_distinct(F.regexp_extract_all(compact, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))).otherwise(short)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: two empty ones are alike, one empty one is unlike any other."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def first_words(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def last_words(text: Column, n: int = 3) -> Column:
    words = tokens(text)
    return F.array_join(F.when(F.size(words) > n, F.slice(words, -n, n)).otherwise(words), " ")


def token_set(text: Column) -> Column:
    """Distinct case-folded words, split at anything that isn't a word character."""
    return F.array_distinct(F.filter(F.split(folded(text), rf"[^{WORD}]+"), lambda x: x != ""))


def metadata_leak(text: Column) -> Column:
    surface = surface_form(text)
    return surface.rlike(METADATA[0]) | surface.rlike(METADATA[1])


def metadata_word(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)
    return F.arrays_overlap(words, F.array(*(F.lit(w) for w in METADATA_WORDS)))


def prohibited(form: Column) -> Column:
    return form.rlike("|".join(f"(?:{p})" for p in PROHIBITED))


def without_prohibited(form: Column) -> Column:
    for p in PROHIBITED:
        form = F.regexp_replace(form, p, " ")
    return squeezed(form)


def carrier_free(number: Column) -> Column:
    """The surface form of a number-masked form without prohibited patterns."""
    return surface_form(without_prohibited(number))


def strip_carrier(words: Column, prefixes: Column, suffixes: Column) -> Column:
    """Words (a column of arrays) without the first of the prefixes and of the suffixes (arrays of word runs, longest first) they start or end with."""
    run = lambda p: F.split(p, " ")
    head = F.get(F.filter(prefixes, lambda p: F.slice(words, 1, F.size(run(p))) == run(p)), F.lit(0))
    rest = F.when(head.isNotNull(), F.slice(words, F.size(run(head)) + 1, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    held = F.transform(F.array(rest), lambda r: F.struct(r.alias("r"), F.get(F.filter(suffixes, lambda s: F.slice(F.reverse(r), 1, F.size(run(s))) == F.reverse(run(s))), F.lit(0)).alias("tail")))
    return F.array_join(F.transform(held, lambda x: F.when(x["tail"].isNotNull(), F.slice(x["r"], 1, F.size(x["r"]) - F.size(run(x["tail"])))).otherwise(x["r"]))[0], " ")


def clean_line(line: Column) -> Column:
    """Quotes and backticks off the ends, white space squeezed."""
    return squeezed(F.regexp_replace(F.trim(line), "^[\"'“”„`]+|[\"'“”„`]+$", ""))


def clean_generated_line(line: Column) -> Column:
    """A list mark off the start, quotes, backticks and blanks off the ends, white space squeezed."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.trim(line), LIST_MARK, ""), "^[ \t\"'“”„`]+|[ \t\"'“”„`]+$", ""))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and sentence: the sentences of the lines outside fences that are no headings, no markup and no short lead-ins that end in a colon."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), LINE_ENDS)).alias("pos", "raw"))
    lines = lines.select(key, "pos", F.trim(F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).alias("s"))
    fences = F.sum(F.col("s").startswith("```").cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    lead_in = F.col("s").endswith(":") & (F.size(tokens(F.col("s"))) <= 5)
    usable = ~F.col("s").startswith("```") & (F.col("fences") % 2 == 0) & (F.col("s") != "") & ~F.col("s").rlike(NOISY_LINE) & ~lead_in
    kept = lines.withColumn("fences", fences).where(usable).select(key, clean_generated_line(F.col("s")).alias("line")).where("line <> ''").where(~F.col("line").rlike(r"^[{}\[\]]"))
    parts = kept.select(key, F.explode(F.split("line", SENTENCE_GAP)).alias("sentence"))
    return parts.select(key, F.trim("sentence").alias("sentence")).where("sentence <> ''")


def spoken_key(text: Column, digits: Column) -> Column:
    """Bare lower-case letters, with each digit word by word from the map `digits`; two texts with one key sound alike."""
    bare = F.lower(bare_letters(text))
    spelled = F.regexp_replace(bare, r"(\d)", " $1 ")
    words = F.filter(F.split(F.regexp_replace(spelled, r"[^a-z0-9]+", " "), " "), lambda x: x != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w)), " ")


# The mark of sentinel texts, what logs print, and what isn't a sentence in a model's output.
SENTINEL = "__sample__:"


def sentinel_text(sample_id: Column, text: Column) -> Column:
    return F.concat(F.lit(SENTINEL), sample_id, F.lit("\t"), text)


def sentinel_id(text: Column) -> Column:
    """The id of a sentinel text, or null if it is malformed."""
    return F.nullif(F.regexp_extract(text, rf"^{SENTINEL}([^\t]+)\t", 1), F.lit(""))


def last_transcript(log: Column) -> Column:
    """The first item of the last list that a log shows as its final transcripts."""
    lists = F.regexp_extract_all(log, F.lit(r"Final streaming transcriptions:\s*\[([^\]]*)\]"), 1)
    return F.regexp_extract(F.try_element_at(lists, F.lit(-1)), r"""^\s*['"]([^'"]*)['"]""", 1)


def active_seconds(log: Column) -> Column:
    found = F.regexp_extract_all(log, F.lit(r"The whole streaming process took:\s*([0-9.]+)\s*s"), 1)
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def flat_json_hash(*fields: tuple[str, Column]) -> Column:
    """Hash of a flat object's compact JSON with sorted keys (strings and integers)."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields)))), 256)


def composite_id(cell: Column, shard: Column, attempt: Column, ordinal: Column) -> Column:
    return F.format_string("%s-s%02d-a%03d-o%04d", cell, shard, attempt, ordinal)


def tri_state(value: Column) -> Column:
    """true, false, or null where malformed."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no", ""), False)


#: Fixed value: what a reason code looks like.
REASON_CODE = r"^[A-Z][A-Z0-9_:-]{1,63}$"


def parsed_codes(value: Column) -> Column:
    """codes and malformed of a JSON array of strings or a list split at ; or ,: broken JSON, items that aren't strings and
    unsupported codes are malformed and give no codes; blank values give none and are well formed."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    tree = F.try_parse_json(F.when(raw.startswith("["), raw))
    listed = F.from_json(F.when(tree.isNotNull(), raw), "array<string>")
    strings = F.size(F.regexp_extract_all(F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*"', '""'), F.lit('""'), F.lit(0))) == F.size(listed)
    parts = F.when(raw.startswith("["), F.when(strings, listed)).otherwise(F.split(raw, "[;,]"))
    codes = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    sound = F.coalesce(F.forall(codes, lambda x: x.rlike(REASON_CODE)), F.lit(False))
    return F.struct(F.when(sound, codes).otherwise(F.array().cast("array<string>")).alias("codes"), (~sound).alias("malformed"))


def normal_path(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def reason_codes(value: Column) -> Column:
    """A JSON array or a list split at ; or , as an array of trimmed codes."""
    parts = F.when(F.trim(value).startswith("["), F.from_json(F.trim(value), "array<string>")).otherwise(F.split(value, "[;,]"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
