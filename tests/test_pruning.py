"""Pruned choices against the same choice over all rows, on skewed parts."""

import pandas as pd

from quillon.operators import selection
from quillon.plans import scoring


def parts(spark, tmp_path):
    rows = [(f"{first} X {last}", n, dear) for first in ("LARGE", "SMALL") for last, n, dear in (("TIN", 90, 1000), ("STEEL", 10, 500), ("COPPER", 10, 100))]
    rows = [(kind, dear + i) for kind, n, dear in rows for i in range(n)] + [("RARE Y ZINC", 1), ("COPPER BRASS STEEL", 5000), ("OTHER Z BRASS", 2), ("ODD BRASS COPPER", 6000)]
    df = pd.DataFrame({"p_partkey": range(len(rows)), "p_retailprice": [float(p) for _, p in rows], "p_type": [k for k, _ in rows], "p_brand": "B1", "p_size": 1, "p_name": "n"})
    spark.createDataFrame(df).write.parquet(str(tmp_path / "part.parquet"))
    return [{"id": i, "rank": -p, "tags": k.split()} for i, (k, p) in enumerate(rows)]


def chosen(df):
    return [r["id"] for r in sorted(df.collect(), key=lambda r: r["place"])]


def test_quota_and_diversity_reach_skewed_rows(spark, tmp_path):
    ranked = sorted(parts(spark, tmp_path), key=lambda r: (r["rank"], r["id"]))
    want = selection.by_quota(ranked, 60, {"STEEL": 5, "BRASS": 5, "COPPER": 5})
    assert chosen(scoring.quota_selection(spark, str(tmp_path))) == [r["id"] for r in want] and sum("COPPER" in r["tags"] for r in want) >= 5
    want = selection.with_diversity([r | {"features": frozenset(r["tags"])} for r in ranked], 40, 15, {})
    assert chosen(scoring.diversity_greedy(spark, str(tmp_path))) == [r["id"] for r in want]
