"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from cuesheet.plans import files, helpers, states, streams, tables, texts, timeline

_PARTS = (timeline, tables, texts, states, files, streams, helpers)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
