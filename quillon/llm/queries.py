"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_quality": "quality",
    "op2_pii": "pii",
    "op3_packing": "packing",
    "op4_license_scan": "license_scan",
    "op5_near_dedup": "near_dedup",
    "op6_line_dedup": "line_dedup",
    "op7_token_id_files": "id_files",
    "op8_language_id": "language_id",
    "op9_prefix_bpe": "prefix_bpe",
    "op10_topk": "topk",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
