"""SQL over whatever Python holds: ``linq(sql, **sources)``.

Sources are DataFrames, lists of records, or paths; ``{name}`` in the text stands for one
of them, ``:name`` for a parameter. Values never become part of the text.
"""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .functions.dialect import to_spark_sql
from .sources.tables import bound


def linq(sql: str, params: dict[str, Any] | None = None, spark: SparkSession | None = None, **sources: Any) -> DataFrame:
    """The query's result as a DataFrame, planned by Catalyst as one query with its sources."""
    frames = [s for s in sources.values() if isinstance(s, DataFrame)]
    spark = spark or (frames[0].sparkSession if frames else SparkSession.active())
    named = {name: bound(spark, value) for name, value in sources.items()}
    return spark.sql(to_spark_sql(sql), args=params, **named)


class Catalog:
    """Names of tables, as views of a session: ``add`` and ``get``, and ``sql`` over all of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, source: Any) -> DataFrame:
        frame = bound(self.spark, source)
        self.tables[name] = frame
        frame.createOrReplaceTempView(name)
        return frame

    def get(self, name: str) -> DataFrame:
        return self.tables[name]

    def materialize(self, name: str, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The result of a query under a name, computed once for all queries that use it and kept
        in memory and on disk over the executors; what is lost with one is computed again."""
        frame = self.sql(text, params).persist(StorageLevel.MEMORY_AND_DISK)
        self.tables[name] = frame
        frame.createOrReplaceTempView(name)
        return frame

    def drop(self, name: str) -> None:
        """Forget a name, and let go of what was kept for it."""
        self.tables.pop(name).unpersist()
        self.spark.catalog.dropTempView(name)

    def sql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        return self.spark.sql(to_spark_sql(text), args=params)
