"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_simhash_pivots": "simhash_pivots",
    "op2_progressive_jpeg": "progressive_jpeg",
    "op3_soft_mixing": "soft_mixing",
    "op4_byte_cnn": "byte_cnn",
    "op5_clause_grammar": "clause_grammar",
    "op6_decontaminate": "decontaminate",
    "op7_line_spread": "line_spread",
    "op8_hash_tree": "hash_tree",
    "op9_chat_format": "chat_format",
    "op10_sentence_spans": "sentence_spans",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"weft.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"weft.llm.{module}") for name, module in _QUERIES.items()}
    return {name: m.ORACLE for name, m in modules.items() if getattr(m, "ORACLE", None)}
