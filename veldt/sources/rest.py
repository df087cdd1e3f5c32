"""A REST endpoint as a Spark data source.

``GET url?column=value&_low=..&_high=..`` gives a JSON list of records. Equality on
searchable columns and ranges of the primary key are pushed into the request; the key's
range may be split over partitions. What the endpoint can't filter, Spark does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import StructType


@dataclass
class Request(InputPartition):
    query: str

    def __init__(self, query: str):
        self.query = query


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.url = options["url"]
        self.key = options.get("key")
        self.searchable = {c.strip() for c in options.get("searchable", "").split(",") if c.strip()}
        self.splits = [int(x) for x in options.get("splits", "").split(",") if x.strip()]
        self.equal: dict[str, object] = {}
        self.low: object = None
        self.high: object = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in self.searchable and name not in self.equal:
                self.equal[name] = f.value
            elif isinstance(f, GreaterThanOrEqual) and name and name == self.key and self.low is None:
                self.low = f.value
            elif isinstance(f, LessThan) and name and name == self.key and self.high is None:
                self.high = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        cuts = [self.low, *[s for s in self.splits if (self.low is None or s > self.low) and (self.high is None or s < self.high)], self.high]
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            query = dict(self.equal) | ({"_low": low} if low is not None else {}) | ({"_high": high} if high is not None else {})
            out.append(Request(urlencode({k: json.dumps(v) if isinstance(v, bool) else v for k, v in query.items()})))
        return out

    def read(self, partition: Request) -> Iterator[tuple]:
        with urlopen(f"{self.url}?{partition.query}" if partition.query else self.url) as answer:
            for row in json.load(answer):
                yield tuple(row.get(n) for n in self.names)


class RestSource(DataSource):
    """Options: url; key (a column with ranges); searchable (columns, by commas); splits (key values, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def reader(self, schema: StructType) -> RestReader:
        return RestReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestSource)
