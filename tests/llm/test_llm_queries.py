"""The registered queries at the smallest scale: those with SQL equal DuckDB, all have the contracts' columns."""

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_itq": ["vec_id", "n_links", "component_id", "kept"],
    "op5_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_tiff": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10_shard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_search": ["item_id", "rank", "doc_id", "score"],
    "op13_tokens": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.queries()[name](spark, DIR).columns == COLUMNS[name]


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DIR)
        assert made.columns == list(corpus_pipeline.COLUMNS), name
        docs = corpus_pipeline.materialize(made, "stage")
        rows.append(docs.count())
    assert rows == sorted(rows, reverse=True) and rows[3] == rows[4] > 100
    assert docs.select("doc_id").distinct().count() == rows[4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).select("doc_id").distinct().count() == rows[4]


def test_pipeline_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "le la", None, None, None), (2, None, "fr", "s", 0), (3, "", "fr", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        at = some
        rows = []
        for _, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.materialize(stage(spark, at, DIR), "odd")
            rows.append(at.select("doc_id").distinct().count() if "sequence_id" in at.columns else at.count())
        # the empty texts are in no language; the equal rows are one document; the null id stays as it is
        assert rows == ([5, 3, 2, 2, 2] if some is docs else [0] * 5)


def test_near_duplicates_keep_texts_apart_under_one_id(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n, n + 30))
    rows = [(1, words(0), "en", "b", 1), (1, words(0), "en", "a", 1), (1, words(100), "en", "a", 1), (2, words(100), "fr", "a", 1), (3, None, None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()}
    assert len(got) == 3 and {rows[1], rows[2]} <= got and {r[0] for r in got} == {1, 3}
