"""Names of all core queries, with their builders and their SQL twins."""

from __future__ import annotations

from functools import wraps

from tideline.plans import audio, media, signals, speech, streams, text, windows
from tideline.runtime import ship

PARTS = (signals, speech, text, windows, streams, audio, media)


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        return f(ship(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for part in PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
