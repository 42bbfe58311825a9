"""Registry of queries, and the shape their results take for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvox.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def _text(c: Column, kind: T.DataType, digits: int) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double"), digits)
    return F.coalesce(c.cast("string"), F.lit(""))


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Plain columns only: whole numbers as bigint, rounded doubles, lists and maps as text.

    Scores that were rounded to be ranked keep those digits; a second rounding to fewer could fall
    either way on a half.
    """
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            item = f.dataType.elementType
            c = F.array_join(F.transform(c, lambda x, k=item: _text(x, k, digits)), "|")
        elif isinstance(f.dataType, T.MapType):
            c = F.array_join(
                F.transform(
                    F.array_sort(F.map_entries(c)),
                    lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
                ),
                "|",
            )
        shown.append(c.alias(f.name))
    return df.select(*shown)


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(configure(spark), sf_dir), digits)

        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
