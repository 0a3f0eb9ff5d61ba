"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from siltstone.llm import alignment, divergence, fingerprints, html_text, language_id, near_dedup, oracles, packing, pii, sharding, source_mixing, topk_search, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_url_rules": url_filters.op1_url_rules,
        "op2_topk_search": topk_search.op2_topk_search,
        "op3_source_mixing": source_mixing.op3_source_mixing,
        "op4_packing": packing.op4_packing,
        "op5_language_id": language_id.op5_language_id,
        "op6_sharding": sharding.op6_sharding,
        "op7_pii": pii.op7_pii,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_html_text": html_text.op9_html_text,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_divergence": divergence.op11_divergence,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": url_filters.oracle(), "op2_topk_search": topk_search.oracle(), "op9_html_text": oracles.HTML_TEXT, "op10_near_dedup": oracles.NEAR_DEDUP, "op11_divergence": divergence.oracle()}
