"""All registered queries and their SQL.

The driver's tables stand in for a corpus: documents are chunks, lang a ticker, an embedding's label a year.
"""

from __future__ import annotations

from dossier.catalogue import answers, ingest, rails, retrieval, texts

_PARTS = (retrieval, answers, rails, ingest, texts)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
