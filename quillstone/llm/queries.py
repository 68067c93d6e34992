"""The queries of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

#: name -> (module, function); modules are imported when the list is asked for.
_QUERIES = {
    "op1_jaccard_join": ("jaccard_join", "op1_jaccard_join"),
    "op2_pii": ("pii", "op2_pii"),
    "op3_maxent_lm": ("maxent_lm", "op3_maxent_lm"),
    "op4_warc": ("warc", "op4_warc"),
    "op5_toxicity": ("toxicity", "op5_toxicity"),
    "op6_quality": ("quality", "op6_quality"),
    "op7_bpe": ("bpe", "op7_bpe"),
    "op8_exact_dedup": ("exact_dedup", "op8_exact_dedup"),
    "op9_substring_dedup": ("substring_dedup", "op9_substring_dedup"),
    "op10_mixing": ("mixing", "op10_mixing"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"quillstone.llm.{module}"), function) for name, (module, function) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from quillstone.llm.sql import ORACLES

    return dict(ORACLES)
