"""The subpackage's queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, html_extract, mixing, secrets, simhash, suffix_dedup, topk, toxicity

_MODULES = {
    "op1_exact_dedup": exact_dedup,
    "op2_simhash": simhash,
    "op3_suffix_dedup": suffix_dedup,
    "op4_mixing": mixing,
    "op5_chat": chat,
    "op6_toxicity": toxicity,
    "op7_html": html_extract,
    "op8_bpe": bpe,
    "op9_secrets": secrets,
    "op10_topk": topk,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
