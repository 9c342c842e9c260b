"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import importlib

#: Module below treeflow.llm and name of its query.
OPERATORS = {
    "op1_suffix_decontamination": "op1_decontaminate",
    "op2_token_efficiency_secrets": "op2_secrets",
    "op3_indexed_warc": "op3_warc",
    "op4_sketch_near_dedup": "op4_near_dedup",
    "op5_prefix_token_counts": "op5_token_counts",
    "op6_pitman_yor_scores": "op6_pitman_yor",
    "op7_pivot_topk": "op7_pivot_topk",
    "op8_balanced_shards": "op8_sharding",
    "op9_hierarchical_packing": "op9_packing",
    "op10_random_indexing_quality": "op10_quality",
}


def queries() -> dict:
    own = {name: getattr(importlib.import_module(f"treeflow.llm.{module}"), name) for name, module in OPERATORS.items()}
    return own | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"treeflow.llm.{module}") for name, module in OPERATORS.items()}
    return {name: m.ORACLE for name, m in modules.items() if hasattr(m, "ORACLE")}
