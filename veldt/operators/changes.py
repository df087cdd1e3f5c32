"""INSERT, DELETE and UPDATE as new DataFrames: the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns by name; those that the rows lack are NULL."""
    return table.unionByName(rows.select(*[c for c in rows.columns if c in table.columns]), allowMissingColumns=True)


def delete(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows stay for which the condition is false or NULL."""
    return table.filter(F.lit(False) if condition is None else ~F.coalesce(condition, F.lit(False)))


def update(table: DataFrame, values: dict[str, Column], condition: Column | None = None) -> DataFrame:
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
