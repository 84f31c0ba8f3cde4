"""Leakage and collisions against loops over the records, with nulls, empty values and ties."""

import random

from pyspark.sql import functions as F

from quillon.operators import leakage


def records(seed, n=150):
    draw = random.Random(seed)
    return [(i, draw.choice("abc"), draw.choice([None, "", "x", "y", f"k{draw.randrange(30)}"]), f"v{draw.randrange(40)}", draw.choice([None, "f1", "f2"]), draw.random() < 0.8) for i in range(n)]


DDL = "candidate_id long, partition_role string, k1 string, k2 string, fam string, ok boolean"


def test_cross_partition_takes_the_last_match(spark):
    rows = records(1)
    pairs = [("a", "c"), ("b", "c")]
    want = []
    for left, right in pairs:
        for k, name in ((2, "k1"), (3, "k2")):
            last = {r[k]: r[0] for r in rows if r[1] == right and r[k]}
            want += [(f"cross_partition_{name}_overlap", f"{left}/{right}", r[0], last[r[k]]) for r in rows if r[1] == left and r[k] in last]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    assert sorted(map(tuple, leakage.cross_partition(df, ["k1", "k2"], pairs).collect())) == sorted(want) and want
    assert leakage.cross_partition(df.limit(0), ["k1"], pairs).collect() == []
    known = {r[2] for r in rows if r[1] == "b"}
    assert sorted(r[0] for r in leakage.absent_sources(df, "a", "b", "k1").collect()) == [r[0] for r in rows if r[1] == "a" and r[2] not in known]
    assert leakage.absent_sources(df, "a", "nobody", "k1").collect() == []


def test_collisions_spare_approved_families(spark):
    rows = records(2)
    want = []
    for k, name, spared in ((2, "k1", False), (3, "k2", True)):
        groups = {}
        for r in rows:
            if r[k]:
                groups.setdefault((r[1], r[k]), []).append(r)
        for (role, _), g in groups.items():
            exempt = spared and len(g) <= 3 and len({r[4] for r in g}) == 1 and all(r[4] and r[5] for r in g)
            if len(g) > 1 and not exempt:
                want.append((f"within_partition_{name}_collision", role, g[0][0], g[1][0], len(g)))
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = leakage.collisions(df, {"k1": False, "k2": True}, F.col("fam"), F.col("ok"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    counts = {(r[0], r[1]): (r[2], r[3]) for r in leakage.distinct_counts(df, ["k1", "k2"]).collect()}
    for role in (None, "a", "b", "c"):
        own = [r for r in rows if (role is None or r[1] == role) and r[2]]
        assert counts[role, "k1"] == (len(own), len({r[2] for r in own}))
