import random
import io
import json
import tarfile
import wave
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import audio, contracts, selection, similarity
from quillon.operators.ranks import global_rank
from quillon.plans import scoring, texts
from quillon.sources import readers, sinks
from quillon.streaming import events


def test_global_rank(spark):
    df = spark.range(1000).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).repartition(5)
    got = global_rank(df, "h", "id").collect()
    assert [r["pos"] for r in sorted(got, key=lambda r: (r["h"], r["id"]))] == list(range(1000))


@pytest.mark.parametrize("threshold", [0.5, 0.72, 1.0])
def test_similar_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    rows = [(i, sorted({str(x) for x in rng.integers(0, 25, rng.integers(0, 12))})) for i in range(80)]
    rows += [(100 + i, r[1] + ["new"]) for i, r in enumerate(rows[:10])]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b and x and y}
    want = {k: v for k, v in want.items() if v >= threshold - 1e-12}
    got = {(r["left"], r["right"]): r["jaccard"] for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, members array<string>"), threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert similarity.similar_pairs(spark.createDataFrame([], "id long, members array<string>"), threshold).count() == 0


def test_representatives_and_capped_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, f string")
    assert {(r["k"], r["rep"]) for r in similarity.representatives(df, "k", F.col("f")).collect()} == {(1, 1), (2, 1), (3, 3)}
    cells = spark.createDataFrame([(i, "hot") for i in range(5)] + [(1, "x"), (2, "x"), (3, "y")], "id long, member string")
    assert [tuple(r) for r in similarity.capped_pairs(cells, cap=3).collect()] == [(1, 2, 1)]


def test_capped_pairs_shuffle_members_once(spark, capsys):
    rng = random.Random(4)
    cells = sorted({(i, f"m{rng.randrange(60) ** 2 // 40}") for i in range(90) for _ in range(3)} | {(i, f"passage{k}") for i in (3, 5, 7) for k in range(20)})
    holders = defaultdict(list)
    for i, m in cells:
        holders[m].append(i)
    want = Counter(pair for ids in holders.values() if len(ids) <= 5 for pair in combinations(ids, 2))
    assert max(map(len, holders.values())) > 6 and min(map(len, holders.values())) == 1
    made = similarity.capped_pairs(spark.createDataFrame(cells, "id long, member string").repartition(3), cap=5)
    made.explain()  # before it runs: the plan once
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(member") == 1 and "Join" not in plan
    assert {(r["left"], r["right"]): r["shared"] for r in made.collect()} == want


def test_quota_and_caps():
    rows = [{"id": i, "rank": -i, "tags": ["a"] if i % 2 else ["b", "c"]} for i in range(10, 0, -1)]
    assert [r["id"] for r in selection.by_quota(rows, 4, {"a": 2})] == [9, 7, 10, 8]
    assert [r["id"] for r in selection.with_category_cap(rows, 5, 2)] == [10, 9, 8, 7, 6]
    with pytest.raises(ValueError):
        selection.with_category_cap(rows, 11, 2)


def test_relaxed_caps_log_their_attempts():
    rows = [{"id": i, "cell": "c", "domain": "d", "source": i % 30, "family": i, "unique": (("t", i),)} for i in range(60)]
    chosen, attempts = selection.with_relaxed_caps(rows, 40)
    assert len(chosen) == 40 and attempts == [("strict", 10), ("domain", 40)]
    with pytest.raises(ValueError):
        selection.with_relaxed_caps(rows[:3], 40)


def test_diversity_and_first_wins():
    rows = [{"id": i, "rank": i, "features": {i % 2}} for i in range(6)]
    assert [r["id"] for r in selection.with_diversity(rows, 3, 5, {1: {0}, 0: {1}})] == [0, 3, 2]
    assert len(selection.with_diversity(rows, 6, 2, {})) == 4
    rows = [{"id": 1, "keys": ["k"], "grams": {"a", "b"}}, {"id": 2, "keys": ["k"], "grams": set()}, {"id": 3, "keys": ["l"], "grams": {"a", "b", "c"}}, {"id": 4, "keys": ["m"], "grams": {"c"}}]
    reasons = [x for _, x in selection.first_wins(rows, lambda a, b: len(a["grams"] & b["grams"]) / len(a["grams"] | b["grams"]) > 0.6)]
    assert reasons == [None, "exact_duplicate", "near_duplicate", None]


@pytest.mark.parametrize("deficit,want", [(0, 0), (1, 1), (40, 1), (41, 2), (999, 5)])
def test_refills(deficit, want):
    assert len(selection.refills([("c", deficit)], 100, 0, 4)) == want
    assert len(selection.refills([("c", deficit)], 1, 0, 4)) == min(1, want)


def test_a_sequential_choice_refuses_too_many_rows(spark):
    with pytest.raises(ValueError):
        selection.in_order(spark.range(10), lambda r: r, "id long", most=5)


def test_queries_without_sql_keep_their_shape(spark):
    d = "/root/testdata/sf0.001"
    assert scoring.wer_rows(spark, d).where("wer < 0 or distance > 2 * words + 10000").count() == 0
    rows = scoring.edit_counts_rows(spark, d).join(scoring.wer_rows(spark, d), ["conv_id", "turn"]).collect()
    assert rows and all(r["substitutions"] + r["deletions"] + r["insertions"] == r["distance"] for r in rows)
    assert scoring.capped_greedy(spark, d).count() == 40


RECORD = "schema_version string, candidate_id string, language string, spoken_text string, target_text string, partition_role string, source_type string, source_id string, source_family_id string, template_family_id string, utterance_family_id string, phenomena array<string>, domain string, license string, generation struct<system string>, entities array<struct<surface string, type string>>, minimal_pair struct<family_id string, contrast string>"
GOOD = ("2.0", "c-1", "sl-SI", "dober dan vsem", "dober dan vsem", "synthetic_candidate", "generated_text", "s1", "sf1", None, "u1", ["p"], "d", "CC0", ("g",), [], None)


@pytest.mark.parametrize(
    "field,value,want",
    [(None, None, None), (0, "1.0", "schema_version"), (1, "!", "candidate_id"), (2, "en", "language"), (3, " x", "text_form"), (3, "drugo besedilo", "text_differs"), (14, None, "generation"), (12, " ", "domain_or_license"), (16, ("f-1", ""), "minimal_pair"), (11, None, "phenomena"), (15, [("", "x")], "entities")],
)
def test_text_record(spark, field, value, want):
    row = [*GOOD]
    if field is not None:
        row[field] = value
    assert spark.createDataFrame([tuple(row)], RECORD).select(contracts.text_record("synthetic_candidate").alias("r")).first()["r"] == want


def test_line_parser_toggles_fences(spark):
    raw = "1. Dober dan\n```\nskrito\n```\nJSON:\n{x}\n* \"Druga\"\n\n"
    rows = texts.parse_lines(spark.createDataFrame([(1, raw)], "id long, raw string"), "id", "raw").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["line"], r["reason"]) for r in rows] == [(1, "Dober dan", None), (2, None, "parser_markdown_fence"), (3, None, "parser_markdown_content"), (4, None, "parser_markdown_fence"), (5, None, "parser_heading"), (6, None, "parser_json_or_markup"), (7, "Druga", None)]


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"b": "x"}\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), schema).count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n[1]\n{bad\n')
    with pytest.raises(readers.BadInput):
        readers.jsonl(spark, str(tmp_path / "y.jsonl"), schema)
    assert readers.jsonl(spark, str(tmp_path / "y.jsonl"), schema, strict=False).count() == 1


def test_tsv(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("id\ttext\n1\ta\n2\t\n1\tb\n")
    rows = readers.tsv(spark, str(tmp_path / "r.tsv"), ["id", "text"]).orderBy("line").collect()
    assert [(r["line"], r["id"], r["issues"]) for r in rows] == [(2, "1", []), (3, "2", ["blank_text"]), (4, "1", [])]
    assert readers.first_by(readers.tsv(spark, str(tmp_path / "r.tsv"), []), "id", "line").where("id = 1").first()["text"] == "a"
    with pytest.raises(readers.BadInput):
        readers.tsv(spark, str(tmp_path / "r.tsv"), ["outcome"])


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.trs").write_text('<T><Turn><Sync time="0.0"/>ena\n<Sync time="2.0"/>dva<Sync time="4.0"/></Turn></T>')
    rows = readers.transcript_segments(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(0.0, 2.0, "ena"), (2.0, 4.0, "dva")]
    (tmp_path / "b.trs").write_text('<T><Turn><Sync time="3.0"/>ena<Sync time="2.0"/>dva<Sync time="4.0"/></Turn></T>')
    with pytest.raises(readers.BadInput):
        readers.transcript_segments(spark, str(tmp_path))


def test_archives_and_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(np.full(1600, 1000, "<i2").tobytes())
    got = audio.audio_stats(readers.wav(spark, str(tmp_path))).first()
    assert got["duration_seconds"] == 0.1 and got["peak"] == pytest.approx(1000 / 32768) and got["active_fraction"] == 1.0
    issues = spark.createDataFrame([tuple(got[c] for c in ("rate", "duration_seconds", "peak", "rms", "active_fraction", "clipping_fraction", "leading_silence", "trailing_silence"))], "rate int, duration_seconds double, peak double, rms double, active_fraction double, clipping_fraction double, leading_silence double, trailing_silence double").select(contracts.audio_issues().alias("i")).first()["i"]
    assert issues == ["duration"]
    for name, member in (("good", "d/rec1.wav"), ("bad", "../rec2.wav")):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as tar:
            info = tarfile.TarInfo(member)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"xx"))
    assert [r["stem"] for r in readers.archive_stems(spark, str(tmp_path / "good.tar")).collect()] == ["rec1"]
    with pytest.raises(readers.BadInput):
        readers.archive_stems(spark, str(tmp_path / "bad.tar"))


@pytest.mark.parametrize("profile,parameters", [("clean", {}), ("noise", {"snr_db": 10}), ("hum", {"level": 0.01, "hertz": 50}), ("band", {"low": 100, "high": 4000}), ("speed", {"factor": 1.1}), ("room", {"seconds": 0.05}), ("codec", {"bits": 8}), ("gain", {"db": -6}), ("shift", {"seconds": 0.01}), ("clip", {"level": 0.1}), ("tilt", {"amount": 0.9})])
def test_transforms_repeat_and_keep_their_peak(profile, parameters):
    x = (np.sin(np.arange(3200) / 7) * 9000).astype(np.int16)
    a, b = (audio.transform(x, profile, parameters, "seed") for _ in range(2))
    assert np.array_equal(a, b) and np.abs(a.astype(int)).max() <= 0.96 * 32768


def test_monitor(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,index,name,memory_used_mib,utilization_percent,power_watts\n1,0,g,100,0,50\n2,0,g,200,90,60\n3,0,g,,5,1\n")
    got = readers.monitor_summary(readers.monitor(spark, str(tmp_path / "m.csv"))).first()
    assert (got["samples"], got["peak_memory"], got["busy_fraction"]) == (2, 200.0, 0.5)
    assert readers.monitor_summary(readers.monitor(spark, str(tmp_path / "m.csv")).limit(0)).first()["samples"] == 0


def test_predictions(spark):
    df = spark.createDataFrame([("__sample__:a\tx y",), ("__sample__:b\t",)], "t string")
    assert {tuple(r) for r in readers.sentinel_predictions(df, "t").collect()} == {("a", "x y"), ("b", "")}
    with pytest.raises(readers.BadInput):
        readers.sentinel_predictions(df.unionAll(df), "t")
    p, r = spark.createDataFrame([(2, "p2"), (1, "p1")], "i long, p string"), spark.createDataFrame([(10, "r1"), (20, "r2")], "j long, r string")
    assert {(x["p"], x["r"]) for x in readers.ordered_predictions(p, r, "i", "j").collect()} == {("p1", "r1"), ("p2", "r2")}


def test_strict_candidates(spark):
    df = spark.createDataFrame([(1, '[{"t": "a"}, {"t": "b"}]'), (2, '{"candidates": [{"t": "c"}]}'), (3, "```json\n[]\n```"), (4, "no")], "id long, raw string")
    got = readers.candidates(df, "raw", "struct<t:string>").select("id", "error", "candidate.t").collect()
    assert sorted((r["id"], r["error"] or "", r["t"] or "") for r in got) == [(1, "", "a"), (1, "", "b"), (2, "", "c"), (3, "not_strict_json", ""), (4, "not_strict_json", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ("z", 1)), (None, None)], "b long, a struct<y string, x long>")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":null,"b":null}', '{"a":{"x":1,"y":"z"},"b":2}']
    assert json.loads(sinks.report(df.limit(1)))[0]["b"] == 2
    assert sinks.refuse_private(spark.createDataFrame([], "a struct<path string>, b long").schema) == ["a.path"]
    assert sinks.absolute_paths(spark.createDataFrame([("see /home/me/x",), ("a/b",)], "t string")).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    q = events.tumbling(events.stream(spark, str(tmp_path / "in")), late="400 days").writeStream.format("memory").queryName("t").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = {tuple(r) for r in src.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start"), "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("t").select("starts", "event_type", "n").collect()} == want


def test_patience_keeps_state(spark, tmp_path):
    rows = [("a", i, w) for i, w in enumerate([9.0, 5.0, 5.0, 6.0, 7.0], 1)]
    spark.createDataFrame(rows, "run string, round long, wer double").coalesce(1).write.parquet(str(tmp_path / "c"))
    curve = spark.readStream.schema("run string, round long, wer double").parquet(str(tmp_path / "c"))
    q = events.patience(curve).writeStream.format("memory").queryName("p").outputMode("update").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [tuple(r) for r in spark.table("p").collect()] == [("a", 2, 5, True)]


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(3)
    for n in (1, 30, 700):
        a = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        for kept in (0, n // 2, n):
            b = np.concatenate([a[:kept], rng.integers(-(2**63), 2**63, n // 3, dtype=np.int64)])
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            found = similarity.least_difference(similarity.parity(a), similarity.parity(b))
            assert found <= apart and found == similarity.least_difference(similarity.parity(b), similarity.parity(a))
            assert found >= min(apart, 2 * len(a), 2 * len(b)) // 3 - 1  # folded to the places of the smaller


def test_similar_pairs_send_no_whole_sets_of_rows_that_only_meet(spark, monkeypatch):
    """Rows that share their rarest members but are far apart are no candidates."""
    rng = random.Random(8)
    rows = [(i, [*range(1000, 1012), *(rng.randrange(10**9) for _ in range(100))]) for i in range(40)] + [(40, list(range(100))), (41, list(range(98)))]
    counts, held = {}, similarity.materialize

    def counted(df, label):
        counts[label] = (made := held(df, label)).count()
        return made

    monkeypatch.setattr(similarity, "materialize", counted)
    got = similarity.similar_pairs(spark.createDataFrame(rows, "id long, members array<bigint>"), 0.8).collect()
    assert [(r["left"], r["right"], r["shared"]) for r in got] == [(40, 41, 98)] and counts["candidates"] == 1


@pytest.mark.parametrize("threshold", [0.85, 0.9])
def test_near_sets_have_an_equal_part(threshold):
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.choice([*range(1, 40), 150, 700])
        a = rng.sample(range(-(10**12), 10**12), n)
        b = [*a[rng.randrange(1 + n // 8) :], *rng.sample(range(2 * 10**12, 3 * 10**12), rng.randrange(2 + n // 8))]
        parts = [set(zip(*(x.tolist() for x in similarity.parts_of(np.array(s, dtype=np.int64), threshold)), strict=True)) for s in (a, b)]
        if len(set(a) & set(b)) >= threshold * len(set(a) | set(b)) - 1e-12:
            (x, y) = parts if len(a) <= len(b) else parts[::-1]
            assert {h for h, _ in x} & {h for h, smaller in y if not smaller}


def test_sets_of_common_words_that_are_not_near_do_not_meet(spark, monkeypatch):
    """Sets from a small stock of words share rare ones, which is no reason to compare them."""
    rng = random.Random(9)
    rows = [(i, rng.sample(range(400), rng.randrange(90, 110))) for i in range(700)]
    for i, (_, own) in enumerate(rows[:60]):
        gone = rng.randrange(8)
        rows.append((1000 + i, [*own[gone:], *(401 + k for k in range(rng.randrange(5)))]))
    met, held = {}, similarity.materialize

    def counted(df, label):
        met[label] = (made := held(df, label)).count()
        return made

    monkeypatch.setattr(similarity, "materialize", counted)
    words = [(i, [f"w{x}" for x in own]) for i, own in rows]
    got = {(r["left"], r["right"]) for r in similarity.similar_pairs(spark.createDataFrame(words, "id long, members array<string>"), 0.9).collect()}
    want = {(a, b) for (a, x), (b, y) in combinations(((i, set(x)) for i, x in rows), 2) if len(x & y) >= 0.9 * len(x | y) - 1e-12}
    assert got == want and 0 < len(want) < 60 and met["met"] < 300


def test_only_sets_of_pairs_are_sent(spark):
    sets = spark.range(500).select("id", F.array("id", F.col("id") + 1).alias("members"))
    got = [r["id"] for r in similarity._of_pairs(sets, spark.createDataFrame([(3, 400), (3, 7)], "id long, id2 long")).collect()]
    assert {3, 7, 400} <= set(got) and len(got) < 10
