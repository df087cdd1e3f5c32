"""Filters, projections, groups, sorts, limits and set operations over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import first_row


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def project(df: DataFrame, *columns: Column | tuple[Column, str]) -> DataFrame:
    """Columns with their alias, or else with their ordinal for a name."""
    return df.select(*[c[0].alias(c[1]) if isinstance(c, tuple) else c.alias(str(i)) for i, c in enumerate(columns)])


def extend(df: DataFrame, **columns: Column) -> DataFrame:
    """The source's columns and computed ones: later steps see both."""
    return df.withColumns(columns)


def nested(*frames: tuple[str, DataFrame]):
    """For select(): each named side of a join as one struct."""
    return [F.struct(F.col(f"{name}.*")).alias(name) for name, _ in frames]


def group(df: DataFrame, keys: list[Column | str], *aggregates: Column, having: Column | None = None) -> DataFrame:
    """One row a group; without keys one row for all, of an empty input too. having sees the output's columns."""
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    return out if having is None else out.filter(having)


def group_with_first(df: DataFrame, keys: list[str], order: Column | str, *aggregates: Column) -> DataFrame:
    """Groups that also carry the columns of their first row by a total order."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(first_row(others, order).alias("_first"), *aggregates).select(*keys, "_first.*", *[c for c in _names(df, keys, aggregates)])


def _names(df: DataFrame, keys: list[str], aggregates: tuple[Column, ...]) -> list[str]:
    return df.groupBy(*keys).agg(*aggregates).columns[len(keys) :] if aggregates else []


def sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """NULLs come first ascending and last descending."""
    return df.orderBy(*order)


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(count)


def distinct(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(keys) if keys else df.distinct()


def union(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    both = left.unionAll(right)
    return both if all else both.distinct()


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    return left.intersectAll(right) if all else left.intersect(right)


def subtract(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    return left.exceptAll(right) if all else left.subtract(right)
