"""Composite operators on small rows: what is asked for, and nulls, repeats and empty sides."""

from pyspark.sql import functions as F

from quillon.operators import composites as c
from quillon.operators.similarity import similar_pairs, with_members_below


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_ledger_takes_duplicates_reasons_and_cells_in_this_order(spark):
    d = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", "p"), (3, "a", "y", "p"), (4, "a", "z", None), (5, "b", None, None), (6, "b", None, None)], "id long, cell string, form string, reason string")
    out = {r.id: (r.decision, r.short) for r in c.ledger(d, "id", F.col("form"), F.col("reason"), "cell", 1, "7").collect()}
    assert out[2] == ("duplicate", False) and out[3] == ("p", False)
    assert sorted([out[1], out[4]]) == [("overflow", False), ("selected", False)]
    assert sorted([out[5], out[6]]) == [("overflow", False), ("selected", False)]  # null forms are no copies of each other
    assert c.ledger(d.where("cell = 'b' and id = 5"), "id", F.col("form"), F.col("reason"), "cell", 2, "7").collect()[0].short
    assert c.ledger(d.where("false"), "id", F.col("form"), F.col("reason"), "cell", 2, "7").count() == 0


def test_whole_file_needs_rows_and_digest(spark):
    d = spark.createDataFrame([("a",), ("b",)], "id string")
    digest = c.whole_file(d, "id", "ACCEPT").first().digest
    assert rows(c.whole_file(d.orderBy(F.desc("id")), "id", "ACCEPT", 2, digest), "id", "outcome") == [("a", "ACCEPT"), ("b", "ACCEPT")]
    assert {r.outcome for r in c.whole_file(d, "id", "ACCEPT", 3, digest).collect()} == {"BLOCKED"}
    other = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {r.outcome for r in c.whole_file(other, "id", "ACCEPT", 2, digest).collect()} == {"BLOCKED"}


def test_approved_groups(spark):
    d = spark.createDataFrame([(1, "f", "r", True), (1, "f", "r", True), (2, "f", "r", True), (2, "g", "r", True), (3, None, "r", True), (4, "f", "r", None), (5, "f", "r", True), (5, "f", "s", True)] + [(6, "f", "r", True)] * 3, "g int, family string, role string, ok boolean")
    out = dict(rows(c.approved_groups(d, "g", F.col("family"), F.col("role"), F.col("ok"), 2), "g", "approved"))
    assert out == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_split_matches_and_exact(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, split string")
    assert rows(c.split_matches(d, d.select("id"), "id", "split"), "split", "matched", "missing", "unexpected", "exact") == [("a", 2, 0, 0, True), ("b", 1, 0, 0, True)]
    said = spark.createDataFrame([(1,), (9,)], "id int")
    out = {r.split: (r.matched, r.missing, r.unexpected, r.exact) for r in c.split_matches(d, said, "id", "split").collect()}
    assert out == {"a": (1, 1, 0, False), "b": (0, 1, 0, False), None: (0, 0, 1, False)}


def test_gates_and_overrides(spark):
    m = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 2, "x")], "gate string, index int, digest string")
    e = spark.createDataFrame([("a", 2, ["y", "x", "x"]), ("b", 2, ["z"]), ("c", 1, ["x"])], "gate string, rows long, digests array<string>")
    out = {r.gate: list(r.issues) for r in c.gate_issues(m, "index", "digest", e).collect()}
    assert out == {"a": [], "b": ["index_coverage", "digests"], "c": ["rows", "index_coverage", "digests"]}
    o = spark.createDataFrame([("m", 4, "PASSED"), ("m", 2, "PASSED"), ("n", 1, "OOM")], "model string, size int, outcome string")
    f = spark.createDataFrame([("m", 4, 2, "OOM"), ("m", 4, 1, "PASSED"), ("z", 1, 1, "PASSED")], "model string, size int, at int, outcome string")
    assert dict(rows(c.first_passed(c.overridden(o, f, ["model", "size"], "at"), "model", "size"), "model", "chosen")) == {"m": 2, "n": None}


def test_plans_shards_and_manifests(spark):
    items, styles = spark.range(3).toDF("item"), spark.range(2).toDF("style")
    done = spark.createDataFrame([(0, 1), (0, 1), (9, 9)], "item long, style long")
    out = c.done_and_left(c.plan(items, styles), done, ["item", "style"])
    assert out.count() == 6 and rows(out.where("done"), "item", "style") == [(0, 1)]
    w = spark.createDataFrame([(1, True), (1, None), (2, True)], "shard int, ok boolean")
    assert rows(c.complete_shards([w, w.where("shard = 1 and ok")], "shard", F.col("ok")), "worker", "shard") == [(0, 2), (1, 1)]
    k = spark.createDataFrame([("a", "v", 1.5), ("b", "v", None)], "key string, voice string, s double")
    assert rows(c.merged_manifests([k, k.where("key = 'a'")], ["key", "voice"], "s", "voice"), "voice", "rows", "seconds", "repeated") == [("v", 3, 3.0, 1)]


def test_pairs_need_a_member_that_few_hold(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 2, 3, 6]), (4, [7, 8]), (5, [7, 8])], "id int, members array<bigint>")
    near = similar_pairs(sets, 0.6)
    assert rows(near, "left", "right") == [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert rows(with_members_below(near, sets, 2), "left", "right") == [(4, 5)]
