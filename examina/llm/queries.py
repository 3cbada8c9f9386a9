"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_token_blocks": "op1_tokens",
    "op2_language_model": "op2_lm",
    "op3_chat_format": "op3_chat",
    "op4_simhash": "op4_simhash",
    "op5_quality_rules": "op5_quality",
    "op6_html_text": "op6_html",
    "op7_nearest_vectors": "op7_ann",
    "op8_source_mix": "op8_mixing",
    "op9_piece_counts": "op9_wordpiece",
    "op10_bpe_round_trip": "op10_bpe",
    "op11_token_alignment": "op11_alignment",
    "op12_periodic_runs": "op12_runs",
    "op13_jaccard_join": "op13_jaccard",
}

QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}

ORACLE_SQL: dict[str, str] = {name: sql for name, module in _MODULES.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}
