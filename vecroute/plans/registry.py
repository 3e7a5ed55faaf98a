"""Named queries over the input tables, and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_vectors"]
FLAGSHIP = "knn_euclidean"

_loaded = [import_module(f"vecroute.plans.{m}") for m in MODULES]
QUERIES = {name: f for m in _loaded for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _loaded for name, sql in m.SQL.items()}
