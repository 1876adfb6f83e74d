"""All queries and their SQL."""

from __future__ import annotations

from brightquay.plans import board, chain, evaluation, models, notices, records, signals, sources, times, upkeep

ALL = board.QUERIES | records.QUERIES | signals.QUERIES | notices.QUERIES | times.QUERIES | evaluation.QUERIES | chain.QUERIES | sources.QUERIES | upkeep.QUERIES | models.QUERIES
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
