"""Query names, their DataFrame functions and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cascades, choices, composites, forms, gates, leaks, proofs, ranked, relational, rulings, scoring, similarity, texts, verdicts

MODULES = (texts, forms, gates, cascades, choices, composites, proofs, relational, ranked, leaks, rulings, verdicts, similarity, scoring)
FLAGSHIP = "admission_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for m in MODULES for name, (made, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
