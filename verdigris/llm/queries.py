"""Queries over the driver tables, one per operator, and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_repeats, licenses, mixing, neardup, quality, token_counts, token_files, topk, toxicity

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_files": token_files.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_topk_search": topk.op5_topk_search,
    "op6_exact_repeats": exact_repeats.op6_exact_repeats,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_license_scan": licenses.op10_license_scan,
}
SQL = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_topk_search": topk.OP5_SQL,
    "op6_exact_repeats": exact_repeats.OP6_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
