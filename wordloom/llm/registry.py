"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from wordloom.llm import ann, exact_dedup, licenses, mixing, packing, pii, quality, simhash, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_mixing": mixing.op3_mixing,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_line_dedup": substring_dedup.op6_line_dedup,
        "op7_personal_data": pii.op7_personal_data,
        "op8_nearest_neighbours": ann.op8_nearest_neighbours,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_license_scan": licenses.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op8_nearest_neighbours": ann.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_license_scan": licenses.OP10_SQL,
    }
