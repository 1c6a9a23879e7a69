"""Registry of named queries: Spark builder + independent oracle SQL.

``QUERIES[name] = (fn(ctx) -> DataFrame, oracle_sql or None)``. Queries are
registered by the operator modules' ``register`` functions (see
``tallyframe.plans.queries``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans.context import Ledger
from tallyframe.session import session_id
from tallyframe.sources.tables import snapshot

QUERIES: dict[str, tuple[Callable[[Ledger], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        old = QUERIES.get(name)
        if old is not None and (old[0].__module__, old[0].__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, oracle)   # a module reload re-registers the same function
        return fn
    return deco


_CONTEXTS: dict[tuple[str, str], tuple[tuple, Ledger]] = {}


def context(spark: SparkSession, sf_dir: str) -> Ledger:
    """The frames over a folder, kept while its files stay the same.

    Frames hold written tables (roll-ups, lattices), so a folder whose files have other sizes or times
    gets new ones; a stopped session's are not found by the next one, which has another id.
    """
    key = session_id(spark), sf_dir
    files = snapshot(spark, sf_dir)
    held = _CONTEXTS.get(key)
    if held is None or held[0] != files:
        held = _CONTEXTS[key] = files, Ledger(spark, sf_dir)
    return held[1]


def spark_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallyframe.plans import queries  # noqa: F401  (registers everything)

    def bind(fn):
        return lambda spark, sf_dir: fn(context(spark, sf_dir))
    return {name: bind(fn) for name, (fn, _) in QUERIES.items()}


def oracle_sqls() -> dict[str, str]:
    from tallyframe.plans import queries  # noqa: F401

    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
