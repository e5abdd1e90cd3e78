"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat, classifier, hard_negatives, html_extract, hyperminhash, mixing, packing, pii, quality_rules, simhash, token_align, url_filter


def queries() -> dict:
    return {
        "op1_ann": ann.query,
        "op2_quality_rules": quality_rules.query,
        "op3_chat": chat.query,
        "op4_html_extract": html_extract.query,
        "op5_pii": pii.query,
        "op6_url_filter": url_filter.query,
        "op7_classifier": classifier.query,
        "op8_packing": packing.query,
        "op9_simhash": simhash.query,
        "op10_mixing": mixing.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_hyperminhash": hyperminhash.query,
        "op13_token_align": token_align.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_hyperminhash": hyperminhash.SQL}
