"""Where queries and their reference SQL are registered."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def draw_sql(stream: str, pid: str = "pid") -> str:
    """The engine's draws: 48 bits of a hash."""
    return f"CAST('0x' || substr(md5('{stream}:' || {pid}), 1, 12) AS BIGINT)"


def uniform_sql(stream: str, pid: str = "pid") -> str:
    return f"({draw_sql(stream, pid)} / 281474976710656e0)"
