"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

import importlib

#: Query name to the module of this subpackage that holds its ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_quality_crf": "quality",
    "op2_jaccard_join": "jaccard_join",
    "op3_toxicity_chain": "toxicity",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_language_id": "langid",
    "op6_exact_dedup": "exact_dedup",
    "op7_personal_data": "pii",
    "op8_secrets": "secrets",
    "op9_mix_sources": "mix",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
