"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from wardlight.llm import divergence, html_text, language_id, line_dedup, lm_score, mixing, near_dups, pieces, quality_rules, resample, sharding, topk, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_jaccard_join": near_dups.op2_jaccard_join,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pieces": pieces.op5_pieces,
        "op6_sharding": sharding.op6_sharding,
        "op7_html_text": html_text.op7_html_text,
        "op8_topk": topk.op8_topk,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mixing": mixing.op10_mixing,
        "op11_language_id": language_id.op11_language_id,
        "op12_divergence": divergence.op12_divergence,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op2_jaccard_join": near_dups.OP2_SQL, "op8_topk": topk.OP8_SQL, "op12_divergence": divergence.OP12_SQL, "op13_resample": resample.OP13_SQL}
