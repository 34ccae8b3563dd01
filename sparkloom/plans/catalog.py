"""The queries of this library and the SQL that states the same result."""

from __future__ import annotations

from . import labels, photos, placement, relational, repair, stats, streams, texts, timeline, transcripts, words

_MODULES = (stats, relational, timeline, texts, streams, transcripts, placement, photos, labels, repair, words)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
