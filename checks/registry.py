"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import with_tables
from meterlight.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Doubles are rounded on both sides, since the engines sum in different orders. Rounding up
# starts at an irrational fraction, which no short decimal (a price, a mean of a few) lies on;
# with one half, the last bit would decide whether such a value goes up or down.
DIGITS = 6
ROUND_UP = 0.3819660112501051


def query(name: str, sql: str | None = None, rounds: str = ""):
    """Register ``function(workspace)`` under ``name``.

    ``sql`` may use the derived tables of ``checks.tables``; ``rounds`` lists the double
    columns to round.
    """
    columns = rounds.split()
    scale = 10.0**DIGITS

    def register(function: Callable[[Workspace], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = function(workspace(spark, folder))
            return result.withColumns(
                {c: F.floor(F.col(c) * scale + ROUND_UP) / scale for c in columns}
            )

        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(
                f"floor({c} * 1e{DIGITS} + {ROUND_UP}e0) / 1e{DIGITS} AS {c}" for c in columns
            )
            choice = f"* REPLACE ({replaced})" if columns else "*"
            ORACLES[name] = with_tables(f"SELECT {choice} FROM (\n{sql}\n) AS answer")
        return function

    return register
