"""The queries of the training-data operators; each module that is named here has query() and may have SQL."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_best_fit_packing": "packing",
    "op2_lm_scoring": "lm_scoring",
    "op3_decontamination": "decontamination",
    "op4_substring_dedup": "substring_dedup",
    "op5_token_output": "token_output",
    "op6_quality": "quality",
    "op7_exact_dedup": "exact_dedup",
    "op8_toxicity": "toxicity",
    "op9_warc": "warc",
    "op10_ngram_jaccard": "jaccard",
    "op11_phrase_collocations": "collocations",
    "op12_pii": "pii",
    "op13_merkle_manifest": "merkle",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
