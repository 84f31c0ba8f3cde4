"""Operator 11 against plain definitions: every run by comparing each period, factors by trying each source."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm import op11_runs
from quillon.llm.runs import factors, runs, stretches, width


def all_runs(a, least):
    out = {}
    for q in range(1, len(a) // 2 + 1):
        i = 0
        while i + q < len(a):
            j = i
            while j + q < len(a) and a[j] == a[j + q]:
                j += 1
            if j > i and j + q - i >= max(2 * q, least(q)):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, f, q) for (b, f), q in out.items())


def drawn(draw):
    n = draw.choice([0, 1, 2, 5, 12, 30, 60])
    a = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(n)]
    if draw.random() < 0.4 and n > 6:
        p = draw.randrange(1, n // 2)
        s = draw.randrange(n - p)
        for i in range(s + p, min(n, s + p * draw.randrange(2, 7))):
            a[i] = a[i - p]
    return a


@pytest.mark.parametrize("seed", range(4))
def test_factors_are_the_longest_with_an_earlier_occurrence(seed):
    draw = random.Random(seed)
    for _ in range(300):
        a, at = drawn(draw), 0
        for start, end, source in factors(a):
            agree = lambda src: next((k for k in range(len(a) - at) if a[src + k] != a[at + k]), len(a) - at)  # noqa: E731, B023
            assert start == at and end - start == max([1, *map(agree, range(at))])
            assert source < 0 and a[at] not in a[:at] or 0 <= source < start and agree(source) >= end - start
            at = end
        assert at == len(a)


@pytest.mark.parametrize(("shortest", "exponent"), [(2, 2), (6, 4), (5, 3), (9, 4), (4, 2.5)])
def test_runs_equal_those_of_every_period(shortest, exponent):
    draw = random.Random(shortest)
    least = lambda q: max(shortest, math.ceil(exponent * q))
    for _ in range(800):
        a = drawn(draw)
        want = all_runs(a, least)
        assert runs(a, least, exponent) == want
        cut = [(s + b, s + f, q) for s, e in stretches(np.array(a, dtype=np.int64), width(shortest, exponent)) for b, f, q in runs(a[s:e], least, exponent)]
        assert sorted(cut) == want


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, lambda q: max(6, 4 * q))
    gone = {i for b, f, q in found for i in range(b + q, f)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{b},{f - b},{q}\n" for b, f, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_the_query_equals_the_definition_on_the_whole_table(spark):
    got = op11_runs.op11_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS and [t for _, t in got.dtypes[1:6]] == ["bigint"] * 5
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(contract(r.doc_id, r.text) for r in rows) and sum(r[1] > 0 for r in got) > 15


def test_odd_rows(spark, tmp_path):
    draw = random.Random(5)
    texts = [None, "", " \t\n", "a " * 6, "a " * 5, "x a b a b a b a b c", "é é é é é é", "a\xa0b " * 9, "a b c " * 4 + "a b d", "A a " * 9] + [" ".join(map(str, drawn(draw))) for _ in range(200)]
    rows = [(i if i % 50 else None, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_runs.op11_runs(spark, str(tmp_path)).collect()), key=str) == sorted((contract(i, t) for i, t, _ in rows), key=str)
    kept = op11_runs.periodic_runs(docs.withColumn("more", op11_runs.F.lit(1)))
    assert kept.columns == ["doc_id", "text", "more", "n_words", "runs", "collapsed"] and kept.count() == len(rows)
    assert op11_runs.periodic_runs(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    period = [f"w{i}" for i in range(1000)]
    text = "start " + " ".join(period * 100) + " end" + " z" * 100_000
    row = op11_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 100_000, 1000), (100_002, 100_000, 1)]
    assert row.collapsed == "start " + " ".join(period) + " end z"
