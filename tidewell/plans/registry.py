"""All queries over the data model's operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its equivalent in SQL."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from tidewell.plans import annotation, curation, extensions, scalars, sequences, trajectory  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance map over normalised time, with the share of episodes in which each dimension is active."""
    from pyspark.sql import functions as F

    q = queries()
    active = q["activity_map"](spark, sf_dir).groupBy("dim").agg(F.avg(F.col("active").cast("double")).alias("active_share"))
    return q["cross_episode_variance"](spark, sf_dir).join(F.broadcast(active), "dim")
