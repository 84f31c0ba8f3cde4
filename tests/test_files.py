"""Readers and writers over files that are split, broken, out of order or half written; audio rows against their contracts."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import audio
from quillon.sources import readers, sinks


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    for name, n in (("a", 2000), ("b", 3), ("c", 700)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}{'é' * (i % 9)}\n" for i in range(1, n + 1)))
    (tmp_path / "d.txt").write_text("")
    got = readers.lines(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == 2703 and all(r.value.rstrip("é") == f"{r.file.rsplit('/', 1)[1][0]}{r.line}" for r in rows)


def test_a_refusal_names_file_and_line(spark, tmp_path, small_splits):
    schema = T.StructType([T.StructField("a", T.LongType())])
    text = [json.dumps({"a": i}) for i in range(1000)]
    (tmp_path / "good.jsonl").write_text("\n".join(text))
    assert readers.jsonl(spark, str(tmp_path), schema).count() == 1000
    text[776] = "[1]"
    (tmp_path / "bad.jsonl").write_text("\n\n" + "\n".join(text))
    with pytest.raises(readers.BadInput, match=r"bad\.jsonl.*'line': 779"):
        readers.jsonl(spark, str(tmp_path), schema)


def test_tsv_of_any_size(spark, tmp_path, small_splits):
    rows = [f"{i}\t{'x' * (i % 5)}\tn" for i in range(2, 900)]
    rows[10], rows[20] = "12\tx", "22\tx\tn\tmore"
    (tmp_path / "r.tsv").write_text("\n".join(["id\ttext\tnote", *rows]))
    got = {r.line: r for r in readers.tsv(spark, str(tmp_path / "r.tsv"), ["id", "text"]).collect()}
    assert all(int(r.id) == line for line, r in got.items()) and len(got) == 898
    assert got[12].issues == ["missing_cells"] and got[12].note is None and got[22].issues == ["extra_cells"]
    assert all(("blank_text" in r.issues) == (r.text == "") for r in got.values())
    (tmp_path / "s.tsv").write_text("id\tid\n1\t2\n")
    with pytest.raises(readers.BadInput, match="repeated"):
        readers.tsv(spark, str(tmp_path / "s.tsv"), ["id"])


TRANSCRIPT = '<?xml version="1.0"?><T><S><Turn who="a"><Sync sure="1" time="0"/>prva &amp; druga\n <Sync time="2.5"/>  <Sync time="3"/>č<Sync time="4"/></Turn><Turn><Sync time="9"/>sam</Turn><Turn><Sync time="4"/>dalje<Sync time="5"/></Turn></S></T>'


def test_transcripts_by_an_xml_parser(spark, tmp_path):
    at = tmp_path / "Set-1" / "STD"
    at.mkdir(parents=True)
    (at / "Rec 1.trs").write_text(TRANSCRIPT, encoding="utf-8")
    rows = readers.transcript_segments(spark, str(tmp_path), mode="std", collection="set-1", forbidden="-pog").orderBy("place").collect()
    assert [(r.place, r.start, r.end, r.text) for r in rows] == [(0, 0.0, 2.5, "prva & druga"), (1, 3.0, 4.0, "č"), (2, 4.0, 5.0, "dalje")]
    assert [r.sample_id for r in rows] == ["recording-rec-1-0000-0000", "recording-rec-1-0000-0002", "recording-rec-1-0002-0000"]
    for need in ({"mode": "pog"}, {"collection": "other"}, {"forbidden": "std"}):
        with pytest.raises(readers.BadInput):
            readers.transcript_segments(spark, str(tmp_path), **need)


@pytest.mark.parametrize(
    ("text", "problem"),
    [("<T><Turn>", "not XML"), ("<T><Turn><Sync/>a<Sync time='1'/></Turn></T>", "without a time"), ("<T><Turn><Sync time='2'/>a<Sync time='2'/></Turn></T>", "empty"), ("<T><Turn><Sync time='0'/>a<Sync time='2'/></Turn><Turn><Sync time='1'/>b<Sync time='3'/></Turn></T>", "overlap")],
)
def test_bad_transcripts_are_refused(spark, tmp_path, text, problem):
    (tmp_path / "x.trs").write_text(text)
    with pytest.raises(readers.BadInput, match=problem):
        readers.transcript_segments(spark, str(tmp_path))


def test_manifests_keep_their_checksum(spark, tmp_path):
    data = '{"id": "a"}\n{"id": "b"}\n'
    (tmp_path / "m.jsonl").write_text(data)
    ask = lambda sha: readers.verified_manifest(spark, str(tmp_path / "m.jsonl"), T.StructType([T.StructField("id", T.StringType())]), 2, ("id",), "id is not null", sha)
    assert ask(hashlib.sha256(data.encode()).hexdigest()).count() == 2
    with pytest.raises(readers.BadInput, match="checksum"):
        ask("0" * 64)


def test_writes_are_whole_and_in_order(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_jsonl(spark.range(500).withColumn("x", (F.col("id") * 7919) % 500).repartition(6), out, ["x"])
    read = lambda: [json.loads(r)["x"] for f in sorted((tmp_path / "out").glob("part-*")) for r in f.read_text().splitlines()]
    assert read() == list(range(500))
    broken = spark.range(500).withColumn("x", F.when(F.col("id") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        sinks.write_jsonl(broken, out)
    assert read() == list(range(500)) and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_manifest(spark.range(10).withColumn("x", -F.col("id")), out, ["id", "x"], "x")
    assert [json.loads(r)["x"] for f in sorted((tmp_path / "out").glob("part-*")) for r in f.read_text().splitlines()] == list(range(-9, 1))
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.mark.parametrize(("up", "down"), [(1, 1), (2, 1), (1, 3), (9, 10), (160, 147), (11, 10)])
def test_resampling_equals_a_direct_convolution(up, down):
    x = np.random.default_rng(up).normal(size=700)
    got = audio.resample(x, up, down)
    assert len(got) == -(-len(x) * up // down)
    if up != down:
        h = audio._low_pass(up, down)
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        want = np.convolve(spread, h)[len(h) // 2 :][::down][: len(got)]
        assert np.allclose(got[: len(want)], want, atol=1e-12)
    assert len(audio.resample(np.empty(0), up, down)) == 0
    tone = np.sin(2 * np.pi * 0.01 * np.arange(4000))
    there = audio.resample(tone, up, down)
    assert np.abs(there - np.sin(2 * np.pi * 0.01 * down / up * np.arange(len(there))))[400:-400].max() < 2e-3


STATS = "file string, channels int, rate int, width int, duration_seconds double, peak double, rms double, active_fraction double, clipping_fraction double, leading_silence double, trailing_silence double, audio_sha256 string"


def test_audio_manifest(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    accepted = spark.createDataFrame([(f"c{i}", f"text {i}", "s", "f", "u") for i in range(7)], "candidate_id string, target_text string, source_id string, source_family_id string, utterance_family_id string")
    good = lambda i: (f"c{i}", f"/a/{i}.wav", f"text {i}", sha(f"text {i}"), "s", "f", "u")
    rows = [good(0), good(0), ("zz", "/a/9.wav", "x", "y", "s", "f", "u"), good(1), ("c2", "/a/2.wav", "other", sha("other"), "s", "f", None), good(3), ("c4", "/a/1.wav", "text 4", sha("text 4"), "s", "f", "u"), good(5)]
    manifest = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, candidate_id string, audio_filepath string, text string, text_sha256 string, source_id string, source_family_id string, utterance_family_id string")
    fine = (1, 16000, 2, 2.0, 0.5, 0.1, 0.9, 0.0, 0.1, 0.1)
    heard = [("/a/0.wav", *fine, "h0"), ("/a/1.wav", *fine, "h1"), ("/a/2.wav", *fine, "h2"), ("/a/3.wav", *[None] * 10, None), ("/a/9.wav", *fine, "h9"), ("/a/5.wav", 2, 8000, 1, 50.0, 0.001, 0.0001, 0.01, 0.2, 4.0, 4.0, "h5")]
    got = sorted(map(tuple, audio.manifest_issues(manifest, accepted, spark.createDataFrame(heard[:-2] + heard[-1:], STATS)).collect()))
    assert got == sorted(
        [("c0", "duplicate_candidate_id"), ("c0", "duplicate_audio_path"), ("c0", "duplicate_audio_sha256"), ("zz", "unexpected_item"), ("c2", "transcript_linkage_mismatch"), ("c2", "utterance_family_id_mismatch"), ("c3", "malformed_audio"), ("c4", "duplicate_audio_path"), ("c4", "duplicate_audio_sha256"), ("c6", "missing_item")]
        + [("c5", x) for x in ("wrong_channels", "wrong_sample_rate", "wrong_sample_width", "duration_out_of_bounds", "low_peak", "low_rms", "low_active_fraction", "clipping", "leading_silence", "trailing_silence")]
    )
    assert ("c0", "missing_audio") in set(map(tuple, audio.manifest_issues(manifest, accepted, spark.createDataFrame(heard[1:], STATS)).collect()))


def test_augmentations(spark):
    ddl = "source_id string, profile_id string, path string, expected_ratio double, observed_ratio double, source_rms double, output_rms double, peak double, peak_gain double, clipping_fraction double, active_fraction double, audio_sha256 string"
    row = lambda s, p, **x: tuple(({"s": s, "p": p, "path": f"/{s}{p}", "e": 0.9, "o": 0.9, "rs": 0.1, "ro": 0.1, "peak": 0.5, "gain": 1.0, "clip": 0.0, "act": 0.9, "sha": f"{s}{p}"} | x).values())
    rows = [row("a", "clean"), row("a", "slow"), row("b", "clean", sha="same"), row("b", "slow", o=1.0, ro=0.2, peak=1.0, sha="aslow"), row("q", "odd", clip=0.5, act=0.0, path="/aslow"), row("c", "slow", ro=0.05, gain=0.5)]
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    got = sorted(map(tuple, audio.augmentation_issues(spark.createDataFrame(rows, ddl), sources, ["clean", "slow"]).collect()))
    assert got == sorted([("b", "slow", x) for x in ("duration_ratio", "rms_match", "peak_limit", "duplicate_hash")] + [("a", "slow", "duplicate_hash"), ("a", "slow", "duplicate_output_path")] + [("q", "odd", x) for x in ("unknown_source", "unknown_profile", "clipping_fraction", "active_fraction", "duplicate_output_path")] + [("c", "clean", "not_once_for_source")])
    assert [tuple(r) for r in audio.voice_coverage(sources, spark.createDataFrame([("a",), ("z",)], "source_id string"), "source_id").collect()] == [("z", 0)]


def test_events_are_plain_and_private_ones_are_told(spark):
    df = spark.createDataFrame([("a", None, [1, 2], {"k": 1}, 1.5), ("see /home/me", 3, None, None, None), ("row-7", 1, None, None, None)], "stage string, step int, xs array<int>, m map<string, int>, share double")
    got = [(json.loads(r.value), r.private) for r in sinks.event_lines(df, (*sinks.MARKERS, "row-")).collect()]
    assert got == [({"stage": "a", "xs": "[1,2]", "m": '{"k":1}', "share": 1.5}, False), ({"stage": "see /home/me", "step": 3}, True), ({"stage": "row-7", "step": 1}, True)]
    with pytest.raises(ValueError):
        sinks.event_lines(df.withColumn("text", F.lit("x")))
    rows = spark.createDataFrame([('{"a": [{"text": 1}]}',), ('{"a": "\\"text\\": 1"}',), (None,)], "j string")
    assert [r[0] for r in rows.select(sinks.forbidden_json(F.col("j"))).collect()] == [True, False, None]
