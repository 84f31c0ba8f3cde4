"""Operator 12 against scores of every document for every query."""

import math
import random
import re
from collections import Counter

import pytest

from quillon.llm import op12_search


def ranked(docs, queries, k):
    lower = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    of = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in of.items()}
    out = []
    for name, text in queries:
        scores = []
        for key, counts, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(w[t] * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(split(text)) & set(counts))
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(name, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 3), (3, 10)])
def test_equals_the_scores_of_all(spark, seed, k):
    draw = random.Random(seed)
    vocabulary = [f"{draw.choice(['w', 'W', 'É', '漢'])}{i}" for i in range(120)]
    text = lambda n: draw.choice([" ", ", ", "\n", "\x00", "_"]).join(vocabulary[min(119, int(draw.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = [(i, text(draw.choice([1, 4, 20, 120]))) for i in range(250)] + [(300, None), (301, ""), (302, "?!"), (None, text(9)), (7, text(5))]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3  # copies tie
    queries = [(i, text(draw.choice([1, 3, 12, 40]))) for i in range(25)] + [(50, None), (51, ""), (52, "absent nowhere"), (None, text(4)), (3, text(4)), (60, docs[3][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, uid string").repartition(5)
    q = spark.createDataFrame([(i, t, 2) for i, t in queries], "item_id long, text string, rank int")
    got = op12_search.search(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, queries, k)


def test_every_term_is_posted_where_the_queries_hold_too_many(spark, monkeypatch):
    docs, queries = [(i, f"a{i % 7} b{i % 5} c") for i in range(60)], [(1, "a1 b2 c"), (2, "b4")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(op12_search, "TERM_BYTES", 1)
    monkeypatch.setattr("quillon.llm.common.BROADCAST_ROWS", 1)
    assert sorted(map(tuple, op12_search.search(d, q).collect()), key=str) == ranked(docs, queries, 10)


def test_few_documents_are_looked_up(spark):
    """The threshold leaves out most postings of a query with one telling term, and the lookup still finds all its score."""
    docs = [(i, "common " * (1 + i % 3) + f"x{i}" + (" rare" if i % 97 == 0 else "")) for i in range(600)]
    queries = [(1, "rare common")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert sorted(map(tuple, op12_search.search(d, q, 3).collect()), key=str) == ranked(docs, queries, 3)


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert op12_search.search(docs.limit(0), queries).collect() == []
    assert op12_search.search(docs, queries.limit(0)).collect() == []
    assert [tuple(r) for r in op12_search.search(docs, queries).collect()] == ranked([(1, "a")], [(1, "a")], 10)
