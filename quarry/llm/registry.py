"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

_MODULES = {
    "op1_ngram_jaccard_join": "ngram_jaccard",
    "op2_best_fit_packing": "packing",
    "op3_language_id": "language_id",
    "op4_benchmark_decontamination": "decontamination",
    "op5_sharding": "sharding",
    "op6_quality_rules": "quality_rules",
    "op7_token_counts": "token_counts",
    "op8_license_scans": "license_scans",
    "op9_substring_dedup": "substring_dedup",
    "op10_token_orc": "token_orc",
    "op11_minhash_near_dedup": "minhash_dedup",
    "op12_spelling_variants": "spelling_variants",
    "op13_source_divergence": "source_divergence",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items() if find_spec(f"{__package__}.{module}")}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items() if find_spec(f"{__package__}.{module}")}
    return {name: sql for name, sql in found.items() if sql}
