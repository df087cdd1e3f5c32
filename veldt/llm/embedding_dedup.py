"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

Vectors are brought to length one, where cosine c is the distance sqrt(2 - 2c). Each of
several tables hashes a vector to the quantised values of a few Gaussian projections;
vectors that meet in a bucket of any table are compared by their exact cosine in double
precision. The number of projections of a table grows with the logarithm of the number of
vectors, so that a vector meets few unrelated ones however many there are; the number of
tables follows from that and the wanted recall of a pair that has exactly the threshold;
closer pairs meet more often.

Equal vectors are one from the start. Buckets give the edges of a spanning forest of the
links found in them; components of these are then compared throughout, block by block, for
the number of links of each vector, so a link isn't counted twice when it is met in two
tables, nor lost when it is met in none but within a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, mix, one_row_an_id, scratch, small_batches, stored, stored_outside
from .pairs import BLOCK, components, forest, groups, in_blocks, meet, shared_keys

THRESHOLD = 0.95
RECALL = 0.999
#: Width of the quantisation in units of the distance at the threshold: near 8 fewest tables do.
WIDTH = 8.0
#: Vectors at a right angle that a vector meets in a table, on average at most.
STRANGERS = 0.05
SEED = 7


def collision(ratio: float) -> float:
    """Probability that a quantised Gaussian projection agrees for points whose distance is 1/ratio of the width."""
    normal = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def projections_for(n: int, threshold: float = THRESHOLD, width: float = WIDTH, strangers: float = STRANGERS) -> int:
    """Projections of a table for n vectors."""
    apart = collision(width * math.sqrt(1 - threshold))
    return max(1, math.ceil(math.log(max(n, 2) / strangers) / -math.log(apart)))


def tables_for(recall: float, projections: int, width: float = WIDTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - collision(width) ** projections))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one, without overflow for large entries."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat).reshape(len(column), -1)


def _keys_of(tables: int, projections: int, width: float, seed: int):
    def drawn(dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, dim])
        return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            size = np.asarray(batch.column("vector").value_lengths())
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                part = batch.take(pa.array(at))
                x = unit(_matrix(part.column("vector")))
                lines, shift = known.setdefault(dim, known.get(dim) or drawn(dim))
                cell = np.floor((x @ lines + shift) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
                key = np.tile(mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(dim)), (len(x), 1))
                for p in range(projections):
                    key = mix(key + cell[:, :, p])
                ids = np.asarray(part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, tables))], names=["key", "id"])

    return run


def _linked(x: np.ndarray, middle: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least the threshold: within x, or across middle if that is inside."""
    if middle == len(x):
        left, right = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        return left, right
    left, right = np.nonzero(x[:middle] @ x[middle:].T >= threshold)
    return left, right + middle


def _same_size(rows: pa.Table, a: int, m: int, b: int) -> np.ndarray:
    return unit(_matrix(rows.column("vector").slice(a, b - a)))


def _edges(threshold: float):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            ids = np.asarray(rows.column("id"))
            low: list = []
            high: list = []
            for a, m, b in groups(rows):
                if m == a or b - a < 2:
                    continue
                x, y = forest(b - a, *_linked(_same_size(rows, a, m, b), m - a, threshold))
                low.append(ids[a + x])
                high.append(ids[a + y])
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["a", "b"])

    return run


def _links(threshold: float):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            ids, copies = np.asarray(rows.column("id")), np.asarray(rows.column("copies"))
            found = np.zeros(len(ids), np.int64)
            for a, m, b in groups(rows):
                if m == a or b - a < 2:
                    continue
                left, right = _linked(_same_size(rows, a, m, b), m - a, threshold)
                found[a:b] += np.bincount(left, copies[a + right], b - a).astype(np.int64) + np.bincount(right, copies[a + left], b - a).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], names=["id", "links"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row a vector: its id, n_links (others with a cosine of at least threshold),
    component_id (the least id reachable by links) and kept (its id is component_id).

    Vectors that are null, empty or zero or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths. Rows whose id is null are left out;
    rows that share an id are one, with the least of their vectors. Other columns are ignored whatever their names; an empty table gives
    no rows.
    """
    small_batches(vectors.sparkSession)
    v = F.col("vector")
    rows = one_row_an_id(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null"), "id")
    sound = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = rows.where(v.isNotNull()).where(sound)
    alike, _ = stored(usable.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    of, _ = stored(usable.join(alike.select("vector", F.col("id").alias("first"), "copies"), "vector").select("id", "first", "copies"), "vector-copies")

    scale = math.sqrt(2 - 2 * threshold) * WIDTH
    projections = projections_for(alike.count(), threshold)
    keys = alike.select("id", "vector").mapInArrow(_keys_of(tables_for(recall, projections), projections, scale, SEED), "key long, id long")
    with scratch(vectors.sparkSession):
        shared, _ = stored(in_blocks(shared_keys(keys), block), "vector-buckets")
        edges, edge_path = stored_outside(meet(shared.join(alike.select("id", "vector"), "id"), _edges(threshold), "a long, b long").distinct(), "vector-edges")
    linked = components(edges, "vectors")
    drop_stored(vectors.sparkSession, edge_path)

    sizes = linked.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    inside = in_blocks(linked.join(sizes, "comp").select(F.col("comp").alias("key"), "id", "members"), block)
    counted = meet(inside.join(alike, "id"), _links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    facts = linked.join(counted, "id").select(F.col("id").alias("first"), "comp", "links")
    known = of.join(facts, "first", "left").select("id", F.coalesce("comp", "first").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.select("id").join(known, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("comp", "id").alias("component_id"),
        (F.coalesce("comp", "id") == F.col("id")).alias("kept"),
    )
