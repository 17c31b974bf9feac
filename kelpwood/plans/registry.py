"""All queries of the engine and the analytics, by name."""

from __future__ import annotations

from . import analytics, engine, records

QUERIES = {**engine.QUERIES, **analytics.QUERIES, **records.QUERIES}
SQL = {**engine.SQL, **analytics.SQL, **records.SQL}
