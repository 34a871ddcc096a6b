"""Registry of the named queries over the driver tables.

Each query is a function ``(spark, sf_dir) -> DataFrame``; most carry the DuckDB
SQL that computes the same rows from the same Parquet tables (the oracle).
Queries without an oracle are checked by row counts and by tests against brute
force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # import for side effects: each module registers its queries
    from parlance.plans import chunking, segments, keys, models, entities, jobs, streams, sinks, analytics, phrases  # noqa: F401


def _shipping(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from parlance.session import ensure_checkpoint_dir, ship_package

        ship_package(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    """Registered queries; each makes sure the workers can import this package
    and that a checkpoint folder is known before building its plan."""
    _load_all()
    return {name: _shipping(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
