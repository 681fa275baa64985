"""The registered queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from tidemark.plans import embeddings, scalars, signals, stars, texts

_MODULES = (signals, embeddings, texts, scalars, stars)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
