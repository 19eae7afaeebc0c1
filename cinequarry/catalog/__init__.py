"""Registered queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from . import browse, ingest, library, modalities, quality, retrieval, speech, timeline

QUERIES = retrieval.QUERIES | library.QUERIES | timeline.QUERIES | quality.QUERIES | modalities.QUERIES | browse.QUERIES | speech.QUERIES | ingest.QUERIES
ORACLES = retrieval.ORACLES | library.ORACLES | timeline.ORACLES | quality.ORACLES | modalities.ORACLES | browse.ORACLES | speech.ORACLES | ingest.ORACLES
