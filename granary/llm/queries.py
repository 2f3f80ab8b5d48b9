"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import html_extract, mixing, packing, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, topk, toxicity
from .oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_packing": packing.op4_packing,
        "op5_sharding": sharding.op5_sharding,
        "op6_simhash": simhash.op6_simhash,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_mixing": mixing.op9_mixing,
        "op10_topk": topk.op10_topk,
    }
