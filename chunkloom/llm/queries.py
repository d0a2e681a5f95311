"""Registered queries of the subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_vector_graph": "vector_graph",
    "op2_warc": "warc",
    "op3_language_mix": "language_mix",
    "op4_pack_dp": "pack_dp",
    "op5_decontaminate": "decontaminate",
    "op6_html_content": "html_content",
    "op7_near_dup": "near_dup",
    "op8_pack_bfd": "pack_bfd",
    "op9_pii": "pii",
    "op10_toxicity": "toxicity",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"chunkloom.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"chunkloom.llm.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
