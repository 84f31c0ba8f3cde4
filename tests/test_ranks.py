"""Ranks, order statistics and digests of skewed groups against sorted lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.digests import one_digest, ordered_digests, set_digests
from quillon.operators.ranks import grouped_rank, order_statistics


def test_grouped_rank_splits_a_hot_group(spark):
    draw = random.Random(1)
    rows = [("hot", draw.random(), i) for i in range(800)] + [(None, draw.random(), i) for i in range(30)] + [(f"g{i % 7}", draw.random(), i) for i in range(40)]
    got = grouped_rank(spark.createDataFrame(rows, "g string, x double, i long").repartition(5), ["g"], "x", "i").collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = [(*r, at, len(held)) for held in by.values() for at, r in enumerate(sorted(held, key=lambda r: r[1:]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("ranges", [64, 1024])
def test_order_statistics(spark, ranges):
    draw = random.Random(2)
    groups = {
        "ties": [3.0] * 500 + [1.0] * 20 + [9.0],
        "wide": [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-30, 30) for _ in range(300)],
        "huge": [-1.7e308, 1.7e308, 0.0, 5e-324],
        "one": [4.5],
        "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.0, 0.5, 0.95):
        got = {r.g: (r.n, r.value) for r in order_statistics(df, "g", "v", F.floor((F.col("n") - 1) * q), ranges).collect()}
        assert got == {g: (len(vs), sorted(vs)[int((len(vs) - 1) * q)]) for g, vs in groups.items()}


def test_digests_pass_the_lines_in_order(spark):
    rows = [(i % 3, i, f"é{i % 11}") for i in range(200)] + [(7, 1, None)]
    df = spark.createDataFrame(rows, "g long, i long, line string").repartition(4)
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    held = {g: [r[2] or "" for r in sorted(rows) if r[0] == g] for g in (0, 1, 2, 7)}
    assert {r.g: (r.n, r.digest) for r in ordered_digests(df, "g", F.col("line"), "i").collect()} == {g: (len(x), sha(x)) for g, x in held.items()}
    assert {r.g: r.digest for r in set_digests(df, "g", F.coalesce("line", F.lit(""))).collect()} == {g: sha(sorted(set(x))) for g, x in held.items()}
    assert one_digest(df.where("line is not null"), "line") == hashlib.sha256("".join(f"{x}\n" for x in sorted(r[2] for r in rows if r[2])).encode()).hexdigest()
    assert ordered_digests(df.limit(0), "g", F.col("line"), "i").collect() == []
