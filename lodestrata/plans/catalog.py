"""Queries over the driver's tables, one for each operator, with DuckDB SQL for the same rows.

The tables hold no source code, so operators run on tables of the same relational shape: a
document is a file, its words are tokens, parts and suppliers are modules, days are scans.
"""

from __future__ import annotations

from lodestrata.plans import code_shapes, findings, graphs, reports, sources, streams, texts, timelines

_MODULES = (texts, graphs, code_shapes, timelines, findings, streams, sources, reports)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
