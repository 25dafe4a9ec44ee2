"""All queries by name, and their SQL."""

from __future__ import annotations

from tracelode.plans import checks, extras, files, grading, groups, learning, measures, pool, probs, traces

_parts = (pool, groups, grading, measures, extras, traces, learning, probs, files, checks)
QUERIES = {k: v for p in _parts for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _parts for k, v in p.ORACLES.items()}
