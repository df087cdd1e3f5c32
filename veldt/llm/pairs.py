"""Candidate pairs from bucket keys, connected components, and exact links inside them,
without ever writing out all pairs of a group.

Rows of a hot bucket or component are dealt to blocks, and blocks meet two by two, so a
task holds two blocks at most. From a block come only the edges of a spanning forest and
a number of links for each row, so what is written grows with the rows, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, group_bounds, stored, whole_groups

#: Rows of a block.
BLOCK = 1024


def shared_keys(keys: DataFrame) -> DataFrame:
    """keys (key, id) whose key has several ids, with that number as ``members``."""
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return keys.join(counted, "key")


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (key, id, members): one for each meeting of blocks in which the row takes part,
    with ``pair`` (which meeting of its key) and ``side`` (0 or 1; 0 where a block meets itself)."""
    n = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return (
        rows.withColumn("blocks", n)
        .withColumn("own", own)
        .withColumn("other", meets)
        .select("key", "id", (low.cast("long") * F.col("blocks") + high).alias("pair"), F.when(low == high, 0).when(F.col("own") == low, 0).otherwise(1).alias("side"))
    )


def meet(rows: DataFrame, compare: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Give compare tables of whole (key, pair) groups."""
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "side").mapInArrow(lambda b: compare(whole_groups(b, ["key", "pair"])), schema)


def groups(table: pa.Table) -> Iterator[tuple[int, int, int]]:
    """start, middle, end of each (key, pair) group; rows from middle on are of the other side."""
    key, pair, side = (np.asarray(table.column(k)) for k in ("key", "pair", "side"))
    bounds = group_bounds(key, pair)
    ones = np.concatenate([[0], np.cumsum(side)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield a, b - int(ones[b] - ones[a]), b


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges over 0..n-1, as few that connect the same: each vertex with the least of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    return label[own], own


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b): id and comp, the least id it is connected with, for each vertex.

    Least labels travel along the edges and then jump to their label's label, until none
    changes. Every round is a stored table, the one before it is deleted.
    """
    spark = edges.sparkSession
    both, edge_path = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    now, path = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), f"{name}-labels")
    while True:
        heard = both.join(now.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        lower = now.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = now.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        after, next_path = stored(lower.join(jump, "comp").select("id", F.least("comp", "further").alias("comp"), "old"), f"{name}-labels")
        changed = after.where("comp <> old").limit(1).count()
        drop_stored(spark, path)
        now, path = after.select("id", "comp"), next_path
        if not changed:
            drop_stored(spark, edge_path)
            return now
