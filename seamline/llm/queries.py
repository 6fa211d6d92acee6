"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import worker_path

#: query: (module, SQL's name in it or None)
OPERATORS = {
    "op1_chat_formatting": ("chat", "SQL"),
    "op2_warc_fixity": ("fixity", "SQL"),
    "op4_quality_rules": ("quality", "SQL"),
    "op5_line_dedup": ("lines", "SQL"),
    "op8_url_filter": ("urls", None),
    "op10_toxicity": ("toxicity", None),
    "op7_decontamination": ("decontamination", None),
    "op6_ngram_join": ("ngram_join", None),
    "op9_suffix_dedup": ("repeats", None),
    "op3_harmonic_packing": ("packing", None),
    "op11_prefix_tokens": ("prefix_tokens", None),
    "op12_fill_middle": ("fill_middle", "SQL"),
    "op13_prefix_trie": ("prefix_trie", "SQL"),
}


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    call = getattr(import_module(f"{__package__}.{module}"), name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        worker_path(spark)
        return call(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, (module, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in OPERATORS.items() if sql}
