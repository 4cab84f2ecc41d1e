"""The queries and SQL twins of this subpackage."""

from __future__ import annotations

from functools import wraps

from tideline.runtime import ship

from . import queries as q
from . import sql


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        return f(ship(spark), sf_dir)

    return run


def queries() -> dict:
    import corpus_pipeline

    own = {name: f for name, f in vars(q).items() if name.startswith("op") and name[2].isdigit()}
    return {name: _shipped(f) for name, f in (own | {"pipeline": corpus_pipeline.run}).items()}


def oracle_sql() -> dict:
    return dict(sql.ORACLES)
