"""Operators for building training data; nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from memolake.llm import fingerprints, jaccard, language, licenses, lm, materialise, mixing, neighbours, packing, periodic, quality_rules, resampling, warc

    return {
        "op1_nearest": neighbours.op1_nearest,
        "op2_warc_round_trip": warc.op2_warc_round_trip,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_packing": packing.op4_packing,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_language_id": language.op6_language_id,
        "op8_lm_score": lm.op8_lm_score,
        "op10_training_order": materialise.op10_training_order,
        "op7_source_mix": mixing.op7_source_mix,
        "op9_license_scan": licenses.op9_license_scan,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_quality_rules": quality_rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from memolake.llm import licenses, mixing, periodic, quality_rules, resampling, warc

    return {
        "op2_warc_round_trip": warc.OP2_SQL,
        "op7_source_mix": mixing.OP7_SQL,
        "op9_license_scan": licenses.OP9_SQL,
        "op11_periodic_runs": periodic.OP11_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
        "op13_quality_rules": quality_rules.OP13_SQL,
    }
