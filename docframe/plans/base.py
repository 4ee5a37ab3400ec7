"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.session import configured

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name, some with SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(function: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                configured(spark)
                return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            run.__doc__ = function.__doc__
            self.queries[function.__name__] = run
            if sql:
                self.sql[function.__name__] = sql
            return function

        return keep


def choice(values: list, number: Column) -> Column:
    """The element of ``values`` at ``number`` modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_choice(values: list, number: str) -> str:
    quoted = ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST(({number}) % {len(values)} AS INTEGER) + 1]"
