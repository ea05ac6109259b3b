"""Registered queries: a Spark plan each, and the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Moves values off the ties of rounding, which engines break differently.
OFF_TIES = 1e-8


def query(sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable:
    """Register a query by its function's name. ``doubles`` names the columns that both sides round."""

    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = plan(spark, sf_dir)
            return found.withColumns({c: F.round(F.col(f"`{c}`") + OFF_TIES, digits) + F.lit(0.0) for c in doubles.split()})

        run.__name__, run.__doc__ = plan.__name__, plan.__doc__
        QUERIES[plan.__name__] = run
        if sql:
            rounded = ", ".join(f'round("{c}" + {OFF_TIES}, {digits}) + 0.0 AS "{c}"' for c in doubles.split())
            ORACLES[plan.__name__] = f"SELECT * {f'REPLACE ({rounded})' if rounded else ''} FROM (\n{sql}\n)"
        return run

    return register
