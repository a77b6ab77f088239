"""Expressions that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns worked out here: what reads them later does not repeat their expressions."""
    kept = [c for c in rows.columns if c not in columns]
    # a projection of its own: there Spark works out what these expressions have in common once, in a generator it does not
    new = rows.select(*kept, F.struct(*(v.alias(c) for c, v in columns.items())).alias("__settled"))
    return new.select(*kept, F.inline(F.array("__settled")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def joined_in_order(order: str, value: Column, separator: str) -> Column:
    """An aggregate: a group's values by order, joined."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order), value.alias("value"))))["value"], separator)


#: The largest method, in bytes, that HotSpot compiles; Spark's own limit lets larger ones be interpreted, row by row.
LARGEST_METHOD = 8000


def compiled(spark: SparkSession) -> None:
    """Sets LARGEST_METHOD in the session, where it has more: steps of many large expressions then run operator by operator, each in methods of
    the size that HotSpot compiles."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > LARGEST_METHOD:
        spark.conf.set(name, str(LARGEST_METHOD))
