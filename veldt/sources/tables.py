"""What can be queried: rows in memory, files, databases, REST endpoints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Lists of up to so many records become relations whose size Catalyst knows.
LOCAL_ROWS = 10_000


def from_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: StructType | str | None = None) -> DataFrame:
    """A list of records. Their columns are those of all of them; what one lacks is NULL.
    An empty list needs a schema. A join broadcasts a short list, instead of dealing the other
    side by keys of which there may be few."""
    rows = [dict(r) for r in rows]
    if schema is None and not rows:
        raise ValueError("an empty list needs a schema")
    if schema is not None:
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        made = spark.createDataFrame([tuple(r.get(n) for n in kind.names) for r in rows], kind)
    else:
        names = list(dict.fromkeys(n for r in rows for n in r))
        made = spark.createDataFrame([{n: r.get(n) for n in names} for r in rows]).select(*names)
    return _local(spark, made) if len(rows) <= LOCAL_ROWS else made


def _local(spark: SparkSession, df: DataFrame) -> DataFrame:
    """What createDataFrame makes of a list is an RDD to Catalyst, of unknown size and so never
    broadcast. The same rows as a local relation; types that Python defines stay as they are."""
    if '"udt"' in df.schema.json():
        return df
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.collectAsList(), df._jdf.schema()), spark)


def from_files(spark: SparkSession, path: str, format: str | None = None, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text, by the path's ending if no format is given. Filters
    and columns are pushed into the scan, partition folders are pruned."""
    kind = format or Path(path.rstrip("/*")).suffix.lstrip(".") or "parquet"
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def from_jdbc(spark: SparkSession, url: str, query: str, **options: Any) -> DataFrame:
    """The rows of a query that a remote SQL server runs."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def from_rest(spark: SparkSession, url: str, schema: StructType | str, **options: Any) -> DataFrame:
    """The records of a REST endpoint; see sources.rest."""
    from .rest import register

    register(spark)
    return spark.read.format("rest").schema(schema).options(**options).option("url", url).load()


@dataclass(frozen=True)
class Remote:
    """A source elsewhere, for ``linq`` and ``Catalog``: a query of a SQL server (kind jdbc) or a
    REST endpoint (kind rest, which needs a schema)."""

    kind: str
    url: str
    query: str | None = None
    schema: StructType | str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.kind == "jdbc":
            return from_jdbc(spark, self.url, self.query, **self.options)
        if self.kind == "rest":
            return from_rest(spark, self.url, self.schema, **self.options)
        raise ValueError(f"no remote source is called {self.kind}")


def bound(spark: SparkSession, source: Any) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Remote):
        return source.frame(spark)
    if isinstance(source, (str, Path)):
        return from_files(spark, str(source))
    return from_rows(spark, source)


def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options: Any) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], mode: str = "error") -> None:
    """A table dealt and sorted by its keys, so that later joins and groups on them need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
