"""Registered queries of the engine, each with its DuckDB SQL where that can state it."""

from __future__ import annotations

from . import charts, logs, points, runs, streams

MODULES = (points, runs, logs, charts, streams)

QUERIES = {k: f for m in MODULES for k, (f, _) in m.ALL.items()}
ORACLES = {k: sql for m in MODULES for k, (_, sql) in m.ALL.items() if sql}
