"""Guards and proofs on small rows: what is asked for, and nulls, repeats and empty sides."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import proofs as p
from quillon.sources.readers import BadInput


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_reviews(spark):
    d = spark.createDataFrame([(1, "a", "ACCEPT"), (2, "a", "ACCEPT"), (3, None, "no"), (4, None, None), (5, "b", "REJECT")], "n int, id string, outcome string")
    found = {r.n: r.issues for r in p.review_issues(d, "id", "outcome", ("ACCEPT", "REJECT"), "n").collect()}
    assert found == {1: [], 2: ["duplicate_id"], 3: ["bad_outcome"], 4: ["bad_outcome"], 5: []}
    with pytest.raises(BadInput):
        p.sound_reviews(d, "id", "outcome", ("ACCEPT", "REJECT"), "n")
    assert p.sound_reviews(d.where("n in (1, 5)"), "id", "outcome", ("ACCEPT", "REJECT"), "n").count() == 2
    assert p.sound_reviews(d.where("false"), "id", "outcome", ("ACCEPT",), "n").count() == 0


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x"), (4, "x"), (None, "x")], "id int, voice string")
    right = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, None, "q"), (4, "x", "r"), (5, "x", None), (None, "x", None)], "id int, voice string, path string")
    out = rows(p.one_to_one_issues(left, right, "id", ("voice",), ("path",)).withColumn("id", F.coalesce("id", F.lit(-1))).withColumn("issues", F.array_join("issues", ",")), "id", "issues")
    assert out == [(-1, "missing_left"), (-1, "missing_right"), (1, ""), (2, "voice_differs,path_repeated"), (3, "path_repeated"), (4, "id_repeated"), (4, "id_repeated"), (5, "missing_left")]
    assert {r.issues[0] for r in p.one_to_one_issues(left, right.where("false"), "id", ("voice",), ("path",)).collect()} == {"missing_right"}


def test_strict_join(spark):
    a, b = spark.createDataFrame([(1, "a")], "id int, l string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, r string")
    assert rows(p.strict_join(a, b, ["id"]), "id", "l", "r") == [(1, "a", "b")]
    for bad in (lambda: p.strict_join(b, a, ["id"]), lambda: p.strict_join(a, b, ["id"], both_ways=True)):
        with pytest.raises(BadInput):
            bad()


def test_coverage_and_overlap(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "key int")
    one = lambda a, b: tuple(p.coverage(a, b, "key").first())
    assert one(k(1, 1, 2, 9), k(1, 2, 3, 3)) == (4, 2, 1, 1, 1)
    assert one(k(), k(1)) == (0, 0, 1, 0, 0) and one(k(1), k()) == (1, 0, 0, 1, 0)
    a = spark.createDataFrame([(1, "t"), (2, " "), (2, None)], "id int, template string")
    b = spark.createDataFrame([(2, "t"), (3, " "), (3, "u")], "id int, template string")
    keys = {"id": F.col("id"), "template": F.col("template"), "none": F.lit(None)}
    assert rows(p.overlap_proof(a, b, keys), "key_name", "left", "right", "shared") == [("id", 2, 2, 1), ("none", 0, 0, 0), ("template", 1, 2, 1)]


def test_projections(spark):
    d = spark.createDataFrame([(1, ("n", (5, "text"), ("/home/x",))), (2, None)], "id int, arm struct<name: string, metrics: struct<rows: int, text: string>, private: struct<path: string>>")
    kept = p.allowed_only(d, "arm", ["name", "metrics.rows", "metrics.absent", "absent"])
    assert kept.schema["arm"].dataType.simpleString() == "struct<name:string,metrics:struct<rows:int>>"
    assert [r.arm and r.arm.asDict(True) for r in kept.orderBy("id").collect()] == [{"name": "n", "metrics": {"rows": 5}}, None]
    assert p.allowed_only(d, "arm", ["absent"]).columns == ["id"]
    j = spark.createDataFrame([('{"a": {"b": 3}}',), ('{"a": {"b": "x"}}',), ("no json",), (None,)], "j string")
    assert [r.b for r in j.select(*p.nested("j", {"b": ("$.a.b", "bigint", -1)})).collect()] == [3, -1, -1, -1]
    g = spark.createDataFrame([(" a ",), ("  ",), (None,), ("b JSON",)], "t string")
    assert rows(p.guidance(g, "t", "JSON"), "t", "refused") == [("a", False), ("b JSON", True)]
    r = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0)], "run string, round int")
    assert rows(p.marked(r, "run", r.where("run = 'x' and round = 1")), "run", "round", "selected") == [("x", 0, False), ("x", 1, True), ("y", 0, False)]
    assert rows(p.first_rows(r, "run", 2), "run") == [("x",), ("x",)]


def test_merged_texts(spark):
    schema = "id int, cell string, form string"
    old = spark.createDataFrame([(9, "a", "f")], schema)
    one = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (4, "b", None)], schema)
    two = spark.createDataFrame([(3, "a", "g"), (5, "b", None), (6, "b", "h"), (7, "c", "f")], schema)
    both, short = p.merged_texts([one, two], old, "id", "cell", "form", 2)
    assert rows(both, "position", "id", "part") == [(0, 9, 0), (1, 2, 1), (2, 4, 1), (3, 5, 1)]
    assert rows(short, "cell", "deficit") == [("a", 1), ("c", 2)]
    both, short = p.merged_texts([one.where("false")], old.where("false"), "id", "cell", "form", 2)
    assert both.count() == 0 and short.count() == 0
