import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import metrics as m
from quillon.functions import text as t


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("Čez  cesto.", "čez cesto"), ("it’s A-B!", "it s a b"), ("  ", ""), ("12:30 ob 5 kg", "12 30 ob 5 kg"), ("éx", "éx"), ("a_b", "a_b")],
)
def test_surface_form(spark, text, want):
    assert one(spark, t.surface_form(t.composed(F.col("x"))), x=text) == want


@pytest.mark.parametrize("text,want", [("12:30 danes", "<NUM> <NUM> danes"), ("5 kg in 3", "<QUANTITY> in <NUM>"), ("a1 b", "a1 b"), ("1 2 3", "<NUM> <NUM> <NUM>"), ("5kg", "<QUANTITY>")])
def test_number_mask(spark, text, want):
    assert one(spark, t.number_masked(F.col("x")), x=text) == want


def test_entity_mask_takes_the_longest_first(spark):
    e = F.array(F.struct(F.lit("Ana").alias("surface"), F.lit("name").alias("type")), F.struct(F.lit("Ana Novak").alias("surface"), F.lit("person").alias("type")))
    assert one(spark, t.entity_masked(F.col("x"), e), x="Ana Novak pozna Ana 3") == "<PERSON> pozna <NAME> <NUM>"


def test_shingles(spark):
    words = F.split("x", " ")
    assert one(spark, t.token_shingles(words, 2), x="a b a b") == ["a b", "b a"]
    assert one(spark, t.token_shingles(words, 5), x="a b") == ["a b"]
    assert one(spark, t.character_shingles(F.col("x"), 3), x="ab cab") == ["abc", "bca", "cab"]
    assert one(spark, t.character_shingles(F.col("x"), 5), x="") == []


@pytest.mark.parametrize("a,b,want", [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    assert one(spark, t.jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_carriers_are_stripped(spark):
    got = one(spark, t.strip_carrier(F.split("x", " "), F.array(F.lit("a b c"), F.lit("a b")), F.array(F.lit("y z"))), x="a b d y z")
    assert got == "d"


def test_leaks(spark):
    assert one(spark, t.metadata_leak(F.col("x")), x="to je row 12") and one(spark, t.metadata_leak(F.col("x")), x="id: 7")
    assert not one(spark, t.metadata_leak(F.col("x")), x="rowing 12")
    assert one(spark, t.metadata_word(F.col("x")), x="A Sample text") and not one(spark, t.metadata_word(F.col("x")), x="samples")


def test_small_forms(spark):
    assert one(spark, t.first_words(F.col("x")), x="a b c") == "a b" and one(spark, t.last_words(F.col("x")), x="a b") == "a b"
    assert one(spark, t.sentinel_id(t.sentinel_text(F.lit("s1"), F.col("x"))), x="t") == "s1" and one(spark, t.sentinel_id(F.col("x")), x="t") is None
    assert one(spark, t.clean_generated_line(F.col("x")), x='1) "Dober  dan"') == "Dober dan"
    assert one(spark, t.reason_codes(F.col("x")), x="a; b,c") == ["a", "b", "c"] and one(spark, t.reason_codes(F.col("x")), x='["a"]') == ["a"]
    assert one(spark, t.tri_state(F.col("x")), x=" TRUE ") is True and one(spark, t.tri_state(F.col("x")), x="maybe") is None
    assert one(spark, t.spoken_key(F.col("x"), F.create_map(F.lit("3"), F.lit("tri"))), x="Čas 3!") == "cas tri"
    assert one(spark, t.folded(F.col("x")), x="Straße") == "strasse"


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_surface_form_is_idempotent(text):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    once = one(spark, t.surface_form(t.composed(F.col("x"))), x=text)
    assert one(spark, t.surface_form(t.composed(F.col("x"))), x=once) == once
    assert unicodedata.is_normalized("NFC", once) or any(unicodedata.combining(c) for c in once)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance(spark):
    rng = random.Random(0)
    rows = [([rng.choice("abcdef") for _ in range(rng.randint(0, 12))], [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    rows.append(([f"w{i}" for i in range(3000)], [f"w{i}" for i in range(5, 3005)]))
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(m.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got[:-1]] == [brute_distance(a, b) for a, b in rows[:-1]] and got[-1]["d"] == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_counts(a, b):
    s, d, i = m.edits(a, b)
    assert min(s, d, i) >= 0 and s + d + i == brute_distance(a, b) and d - i == len(a) - len(b)


@pytest.mark.parametrize("r,h,want", [("ena dva tri štiri", "ena dva tri štiri", 0.0), ("pet", "", 100.0), ("", "", 0.0), ("", "x", 100.0), ("a b", "a c", 50.0)])
def test_word_error_rate(spark, r, h, want):
    assert one(spark, m.word_error_rate(F.col("r"), F.col("h")), r=r, h=h) == want


@pytest.mark.parametrize("h,want", [(" ", "EMPTY_HYPOTHESIS"), ("a b", "EXACT_MATCH"), ("a c", "IMPROVED"), ("x y z", "REGRESSED"), ("q w", "UNCHANGED")])
def test_recognition_change(spark, h, want):
    assert one(spark, m.recognition_change(F.col("r"), F.col("b"), F.col("h")), r="a b", b="x y", h=h) == want


@pytest.mark.parametrize("v,want", [(0.1235, 0.123), (2.5, 2.0)])
def test_rounding(spark, v, want):
    assert one(spark, m.rounded(F.col("v"), 3 if v < 1 else 0), v=v) == want


def test_seeds(spark):
    import hashlib

    digest = hashlib.sha256(b"k:p").hexdigest()
    assert one(spark, m.unit_interval(F.col("a"), F.col("b")), a="k", b="p") == int(digest[:12], 16) / 0xFFFFFFFFFFFF
    assert one(spark, m.seed_31(F.col("a"), F.col("b")), a="k", b="p") == int(digest[:12], 16) % (2**31 - 1)
    assert one(spark, m.chosen(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("a"), F.col("b")), a="k", b="p") == "xyz"[int(digest[:8], 16) % 3]


def test_no_carrier_leaves_the_words(spark):
    none = F.array().cast("array<string>")
    assert one(spark, t.strip_carrier(F.split("x", " "), none, none), x="a b") == "a b"


def test_surface_form_has_the_word_class_of_python(spark):
    """Marks and connectors are no word characters, all numbers are."""
    import re
    import unicodedata

    texts = ["a̱b x² ½ p‿q", "naïve—Ⅷ one_two", "é – don’t", "٣ ১ x‍y", "日本 が", "a-b  c", "ǅ ß İ"]
    want = []
    for x in texts:
        x = unicodedata.normalize("NFC", x)
        for c in "’‘`´":
            x = x.replace(c, "'")
        want.append(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", x.replace("-", " ").lower())).strip())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r["s"] for r in df.select("i", t.surface_form(t.composed(F.col("x"))).alias("s")).orderBy("i").collect()]
    assert got == want


@pytest.mark.parametrize("cells", [1, 60, 100_000])
def test_edits_of_pairs_equal_one_by_one(cells):
    rng = random.Random(5)
    made = lambda: np.array([rng.randrange(4) for _ in range(rng.randrange(12))], dtype=np.int64)
    sides = [(made(), made()) for _ in range(200)]
    want = [m.edits(list(r), list(h)) for r, h in sides]
    assert [tuple(x) for x in m.edits_of_pairs([r for r, _ in sides], [h for _, h in sides], cells).tolist()] == want
    assert m.edits_of_pairs([], []).shape == (0, 3)
