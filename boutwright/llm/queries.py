"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from . import alignment, decontam, html_text, jaccard, licenses, packing, periods, quality, repeats, sharding, simhash, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_licenses": licenses.op3_licenses,
        "op4_repeats": repeats.op4_repeats,
        "op5_html_text": html_text.op5_html_text,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sharding": sharding.op7_sharding,
        "op8_packing": packing.op8_packing,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_simhash": simhash.op10_simhash,
        "op11_alignment": alignment.op11_alignment,
        "op12_jaccard": jaccard.op12_jaccard,
        "op13_periods": periods.op13_periods,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.OP2_SQL, "op9_decontamination": decontam.OP9_SQL}
