"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_substring import OP1_SQL, op1_substring
from .op02_language import language_of_pages, op2_language
from .op03_packing import op3_packing
from .op04_itq import OP4_SQL, op4_itq
from .op05_urls import op5_urls
from .op06_toxicity import op6_toxicity
from .op07_bpe import op7_bpe
from .op08_simhash import op8_simhash
from .op09_tiff import op9_tiff
from .op10_shard import op10_shard
from .op11_runs import op11_runs
from .op12_search import OP12_SQL, op12_search
from .op13_tokens import op13_tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring, op2_language, op3_packing, op4_itq, op5_urls, op6_toxicity, op7_bpe, op8_simhash, op9_tiff, op10_shard, op11_runs, op12_search, op13_tokens, language_of_pages)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1_SQL, "op4_itq": OP4_SQL, "op12_search": OP12_SQL}
