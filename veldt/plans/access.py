"""Access paths: which of a table's sorted copies a predicate's alternatives should be read from.

An index is a copy of a table, dealt by range and sorted by its columns, and a histogram of
it: what each file holds at least and at most, and how many rows. A predicate's alternatives
(``predicates.ranges``) become ranges of the index's leading columns, which Parquet's row
groups are pruned by; the histogram tells about how many rows each index would read, and
the cheapest one is taken for each alternative. Alternatives that use one index are read in
one scan. Without an index for some alternative the table is scanned as it is.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as p


@dataclass(frozen=True)
class Index:
    """A sorted copy of a table. bins: (least key, greatest key, rows) of its files; rows with a
    NULL in the key, which no range holds, aren't counted."""

    name: str
    columns: tuple[str, ...]
    path: str
    bins: tuple[tuple[tuple, tuple, int], ...] = field(repr=False, default=())

    def rows(self) -> int:
        return sum(n for _, _, n in self.bins)

    def usable(self, arm: dict[p.Col, p.Range]) -> list[p.Range]:
        """Ranges of its leading columns in an alternative: points, and behind them one range at most."""
        by_name = {c.name: r for c, r in arm.items()}
        out: list[p.Range] = []
        for name in self.columns:
            if name not in by_name:
                break
            out.append(by_name[name])
            if not _point(by_name[name]):
                break
        return out

    def estimate(self, spans: list[p.Range]) -> int:
        """Rows of the files that may hold such keys."""
        total = 0
        for low, high, n in self.bins:
            depth = next((i for i, s in enumerate(spans) if low[i] != high[i]), len(spans) - 1)
            if all(_meets(s, low[i], high[i]) for i, s in enumerate(spans[: depth + 1])):
                total += n
        return total


def _point(span: p.Range) -> bool:
    return span.low is not None and span.low == span.high


def _meets(span: p.Range, low, high) -> bool:
    return not p.Range(low, True, high, True).meet(span).empty()


def index_map(indexes: Collection[Index]) -> dict[str, list[Index]]:
    """The indexes that each column takes part in."""
    out: dict[str, list[Index]] = {}
    for i in indexes:
        for c in i.columns:
            out.setdefault(c, []).append(i)
    return out


@dataclass(frozen=True)
class Scan:
    """One scan of an index for some alternatives; of the table itself if index is None."""

    index: Index | None
    arms: tuple
    rows: int


@dataclass(frozen=True)
class Access:
    """Scans to be united, the filter that is left, and whether rows still have to be sorted. No scans: no row can hold."""

    scans: tuple[Scan, ...]
    residual: Any
    sort: tuple[str, ...] = ()

    def rows(self) -> int:
        return sum(s.rows for s in self.scans)


def choose(tree, indexes: Collection[Index], count: int, order: tuple[str, ...] = (), whole: Collection[str] | None = None) -> Access:
    """How to read a table of ``count`` rows for a predicate. order: columns that the rows should rise by.

    A full scan is taken where an alternative has no index, where reading it costs no less
    than the whole table, or where there are no bounds at all. Ties go to the index whose
    order serves ``order``, then to the one with more columns bound.
    """
    full = Access((Scan(None, (), count),), tree, order)
    arms = p.ranges(tree, whole=whole)
    if arms is None:
        return full
    if not arms:
        return Access((), p.FALSE, ())
    chosen: dict[Index, list] = {}
    for arm in arms:
        found = [(i.estimate(spans), i.columns[: len(order)] != order, -len(spans), n) for n, i in enumerate(indexes) if (spans := i.usable(arm))]
        if not found:
            return full
        chosen.setdefault(list(indexes)[min(found)[-1]], []).append(arm)
    scans = tuple(Scan(i, tuple(own), min(i.rows(), sum(i.estimate(i.usable(a)) for a in own))) for i, own in chosen.items())
    if sum(s.rows for s in scans) >= count:
        return full
    return Access(scans, tree, order)


def _bounds(spans: dict[str, p.Range]) -> Column:
    out = F.lit(True)
    for name, s in spans.items():
        own = F.col(name)
        if s.low is not None:
            out = out & (own >= s.low if s.low_in else own > s.low)
        if s.high is not None:
            out = out & (own <= s.high if s.high_in else own < s.high)
    return out


class IndexedTable:
    """A table and its indexes: statistics and ranges by index, and the cheapest way for a predicate."""

    def __init__(self, frame: DataFrame):
        self.spark, self.frame = frame.sparkSession, frame
        self.whole = p.whole_columns(frame.schema)
        self.indexes: dict[str, Index] = {}
        self._count: int | None = None

    def count(self) -> int:
        """Rows; of files, from their footers."""
        if self._count is None:
            self._count = self.frame.count()
        return self._count

    def add_index(self, name: str, columns: list[str], path: str, files: int | None = None) -> Index:
        """Write the copy and gather its histogram: one row comes to the driver for each file, of
        which there are as many as shuffle partitions if no number is given."""
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.frame.repartitionByRange(n, *columns).sortWithinPartitions(*columns).write.parquet(path)
        key = F.struct(*columns)
        copy = self.spark.read.parquet(path).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
        found = copy.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).collect()
        self.indexes[name] = Index(name, tuple(columns), path, tuple(sorted((tuple(r.low), tuple(r.high), r.n) for r in found)))
        return self.indexes[name]

    def statistics(self, index: str, spans: list[p.Range]) -> int:
        """About how many rows the index holds in ranges of its leading columns: never fewer than there are."""
        return self.indexes[index].estimate(spans)

    def fetch(self, index: str | None = None, spans: list[p.Range] | None = None) -> DataFrame:
        """The rows in ranges of the index's leading columns; all rows without an index."""
        if index is None:
            return self.frame
        own = self.indexes[index]
        return self.spark.read.parquet(own.path).where(_bounds(dict(zip(own.columns, spans or [], strict=False))))

    def plan(self, tree, order: tuple[str, ...] = ()) -> Access:
        return choose(tree, list(self.indexes.values()), self.count(), order, self.whole)

    def where(self, tree, order: tuple[str, ...] = ()) -> DataFrame:
        """The rows for which a predicate holds, by the cheapest way, sorted by ``order`` if given.

        Scans of different indexes are made disjoint: each leaves out what an earlier one's
        alternatives hold.
        """
        access = self.plan(tree, order)
        test = p.column(access.residual)
        if not access.scans:
            return self.frame.where(F.lit(False))
        parts, taken = [], []
        for scan in access.scans:
            source = self.frame if scan.index is None else self.spark.read.parquet(scan.index.path)
            for arm in taken:
                source = source.where(~F.coalesce(arm, F.lit(False)))
            own = [_bounds({c.name: r for c, r in arm.items()}) for arm in scan.arms]
            if own:
                either = own[0]
                for other in own[1:]:
                    either = either | other
                source = source.where(either)
                taken.append(either)
            parts.append(source.where(test).select(*self.frame.columns))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out.orderBy(*access.sort) if access.sort else out
