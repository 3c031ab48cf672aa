"""How a query and its SQL are made comparable: doubles are rounded to six digits on both sides, and -0 is 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions.numeric import rounded
from tallyspark.plans.adapter import RUNS_SQL, runs

Query = Callable[[SparkSession, str], DataFrame]


def of_runs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(f(runs(spark, sf_dir)), 6, half_even=False)


def of_tables(f: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(f(spark, sf_dir), 6, half_even=False)


def rounded_sql(body: str, others: str = "", ctes: str = "") -> str:
    """`others`: the columns that are no numbers."""
    names = [x.strip() for x in others.split(",") if x.strip()]
    exclude = f" EXCLUDE ({', '.join(names)})" if names else ""
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join([*names, f'round(COLUMNS(*{exclude}), 6) + 0'])} FROM ({body}) AS body"


def runs_sql(body: str, others: str = "", *ctes: str) -> str:
    return rounded_sql(body, others, ", ".join([RUNS_SQL, *ctes]))


def literal(rows: list[tuple]) -> str:
    """A VALUES list."""

    def said(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(said(x) for x in r) + ")" for r in rows)


