"""All registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_chat", "q_quality", "q_language", "q_toxicity", "q_html", "q_tokens", "q_dedup", "q_mixing", "q_decontaminate", "q_fill_middle", "q_merkle", "q_sentence_pieces"]

_loaded = [import_module(f"vecroute.llm.{m}") for m in MODULES]
QUERIES = {name: f for m in _loaded for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _loaded for name, sql in m.SQL.items()}
