"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

A document's set holds the hashes of its runs of ``gram`` words. In each of several runs a
set chooses the tokens whose hash under the run falls below 1 / (threshold * its size);
similar sets choose the same ones. A set goes to the bucket of each token chosen. Buckets
of moderate size are compared by brute force, larger ones are split again by tokens chosen
under the next level's hash, twice as many; what is still large at the last level is
compared in blocks, so nothing is capped. The number of runs follows from the wanted recall.

Equal sets are one from the start. A bucket compares 512-bit sketches and gives a spanning
forest of what passes. Of small sets the sketch holds the parity of each bin's tokens: two
sketches differ in no more bits than the sets in tokens, so no pair at the threshold is
dropped. Of large ones it is one-permutation hashing, densified, against a bound far below
the threshold; inside the components of these, all sets are compared exactly, in blocks.
From there come each document's number of links and, again as forests, the classes. Pairs
are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, configured, drop_stored, mix, one_row_an_id, release, rolling, scratch, small_batches, stored, stored_outside, text_batches
from .pairs import components, forest, groups, in_blocks, meet, shared_keys

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
LEVELS = 2
#: Tokens that a pair at the threshold shares on average, at least, of those chosen at each level.
SHARED = (1.0, 2.0)
#: Buckets up to this size are compared as they are; larger ones are split at the next level.
SPLIT = 8192
#: Sketch rows, and sets, of a block.
SKETCH_BLOCK = 2048
SET_BLOCK = 1024
BITS = 512
#: Sets below this size are compared by parities, which lose no pair.
SHORT = 256
#: Sketches of other sets estimate the similarity with a standard deviation of about 0.03; this far below the threshold a pair is dropped.
MARGIN = 0.17

_SIGNED = "id long, set_a long, set_b long, size long, sketch binary, parity binary, path_key array<long>, path_run array<int>, more_run array<int>, more_level array<int>, more_token array<long>"


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met at the given depth with that probability.

    Of the tokens chosen at a level a pair at the threshold shares SHARED on average at least,
    so it shares one with probability 1 - exp(-SHARED) at least.
    """
    met = math.prod(1 - math.exp(-n) for n in SHARED[:levels])
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingle_sets(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct word-run hashes, sorted within each, and how many each has.

    A text of fewer words than gram, but not none, has the run of all its words.
    """
    words = Words(texts, ALNUM, lower=True)
    at, hashes = words.windows(gram)
    bounds = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, b, n) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), words.count.tolist(), strict=True)):
        if b > a:
            own = np.sort(hashes[a:b])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            first = words.first[i : i + 1]
            own = mix(rolling(words.hash, first, first + n) + np.uint64(n))
        else:
            continue
        sizes[i] = len(own)
        parts.append(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def _probe(turn: int) -> np.ndarray:
    """The bin from which each empty bin borrows at its turn-th try."""
    return (mix(np.arange(BITS, dtype=np.uint64) + np.uint64(turn << 16)) % np.uint64(BITS)).astype(np.int64)


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One bit for each bin's least hash; an empty bin takes that of another, by a fixed sequence of tries."""
    least = np.full(n * BITS, ~np.uint64(0))
    np.minimum.at(least, owner * BITS + (hashes >> np.uint64(55)).astype(np.int64), hashes)
    least = least.reshape(n, BITS)
    full = least != ~np.uint64(0)
    bit = (mix(least) & np.uint64(1)).astype(bool)
    row, col = np.nonzero(~full & full.any(1)[:, None])
    turn = 0
    while len(row):
        turn += 1
        source = _probe(turn)[col]
        found = full[row, source]
        bit[row[found], col[found]] = bit[row[found], source[found]]
        row, col = row[~found], col[~found]
    return np.packbits(bit, axis=1)


def parities(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One bit for each bin: whether the number of hashes in it is odd."""
    count = np.bincount(owner * BITS + (hashes >> np.uint64(55)).astype(np.int64), minlength=n * BITS)
    return np.packbits((count & 1).astype(bool).reshape(n, BITS), axis=1)


def has_parity(sizes: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """Sets below SHORT, and those large enough to be similar to one of them."""
    return (sizes >= least) & (sizes * threshold < SHORT)


def _marks(kind, has: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> pa.Array:
    """Sketches of one kind of the sets that have it, of the others none."""
    use, number = has[owner], np.cumsum(has) - 1
    marks = kind(hashes[use], number[owner[use]], int(has.sum()))
    return pa.array([marks[number[i]].tobytes() if h else b"" for i, h in enumerate(has.tolist())], pa.binary())


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _sign(gram: int, threshold: float, runs: int):
    seeds = np.random.default_rng(11).integers(1, 1 << 63, (runs, LEVELS), dtype=np.uint64) | np.uint64(1)
    #: Sets below this size are similar to none but equal ones: one of m, inside another of m + 1, has m / (m + 1) of it.
    least = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            n = len(texts)
            hashes, sizes = shingle_sets(texts, gram)
            owner = np.repeat(np.arange(n), sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = []
            for salt in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)])
                sums.append(mix(total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            use = np.repeat(sizes >= least, sizes)
            hashes, owner = hashes[use], owner[use]
            limits = [np.minimum(n * 2.0**64 / (threshold * np.maximum(sizes, 1)), 2.0**64 - 2048).astype(np.uint64)[owner] for n in SHARED]
            picked: list[tuple] = []
            for r in range(runs):
                for level in range(LEVELS):
                    at = np.flatnonzero(hashes * seeds[r, level] < limits[level])
                    picked.append((owner[at], np.full(len(at), r), np.full(len(at), level), mix(hashes[at] + seeds[r, level])))
            who, which, depth, token = (np.concatenate(x) for x in zip(*picked, strict=True))
            order = np.argsort(who, kind="stable")
            who, which, depth, token = who[order], which[order], depth[order], token[order].view(np.int64)
            top = depth == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    *map(pa.array, sums),
                    pa.array(sizes),
                    _marks(sketches, sizes >= max(least, SHORT), hashes, owner),
                    _marks(parities, has_parity(sizes, least, threshold), hashes, owner),
                    _lists(who[top], n, token[top], pa.int64()),
                    _lists(who[top], n, which[top], pa.int32()),
                    _lists(who[~top], n, which[~top], pa.int32()),
                    _lists(who[~top], n, depth[~top], pa.int32()),
                    _lists(who[~top], n, token[~top], pa.int64()),
                ],
                names=["id", "set_a", "set_b", "size", "sketch", "parity", "path_key", "path_run", "more_run", "more_level", "more_token"],
            )

    return run


def _alike(x: np.ndarray, middle: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sketches that differ in at most as many bits as the sum of their ``most``, within x or across middle."""
    left: list = []
    right: list = []
    for i in range(min(middle, len(x) - 1)):
        begin = i + 1 if middle == len(x) else middle
        near = np.flatnonzero(np.bitwise_count(x[begin:] ^ x[i]).sum(1, dtype=np.int32) <= most[begin:] + most[i])
        if len(near):
            left.append(np.full(len(near), i))
            right.append(near + begin)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sketch_edges(threshold: float):
    half = (1 - max(0.0, threshold - MARGIN)) / 4 * BITS
    # Similar sets of x and y tokens differ in (1 - threshold) / (1 + threshold) * (x + y) of them at most.
    share = (1 - threshold) / (1 + threshold)

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            ids = np.asarray(rows.column("id"))
            kinds = []
            for name in ("sketch", "parity"):
                found = [(i, x) for i, x in enumerate(rows.column(name).to_pylist()) if x]
                marks = np.frombuffer(b"".join(x for _, x in found), np.uint64).reshape(-1, BITS // 64)
                at = np.array([i for i, _ in found], np.int64)
                kinds.append((at, marks, np.full(len(at), half) if name == "sketch" else share * np.asarray(rows.column("size"))[at] + 1e-6))
            low: list = []
            high: list = []
            for a, m, b in groups(rows):
                if m == a or b - a < 2:
                    continue
                for at, marks, most in kinds:
                    i, k, j = np.searchsorted(at, [a, m, b])
                    if k == i or j - i < 2 or (m < b and k == j):
                        continue
                    left, right = _alike(marks[i:j], k - i, most[i:j])
                    if len(left):
                        x, y = forest(j - i, left, right)
                        low.append(ids[at[i + x]])
                        high.append(ids[at[i + y]])
            if low:
                pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _similar(sets: list[np.ndarray], middle: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of the threshold at least."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    across = middle < n
    rows, cols = (middle, n - middle) if across else (n, n)
    owner = np.repeat(np.arange(n), sizes)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    keep = often[inverse]
    owner, at = owner[keep], column[inverse[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((rows, cols), np.float32)
    width = max(64, (1 << 24) // max(n, 1))
    for begin in range(0, int(often.sum()), width):
        a, b = np.searchsorted(at, [begin, begin + width])
        x = np.zeros((n, min(width, int(often.sum()) - begin)), np.float32)
        x[owner[a:b], at[a:b] - begin] = 1
        common += x[:middle] @ x[middle:].T if across else x @ x.T
    total = sizes[:rows, None] + sizes[None, middle if across else 0 :]
    linked = common >= threshold * (total - common) - 1e-6
    if not across:
        linked = np.triu(linked, 1)
    left, right = np.nonzero(linked)
    return left, right + (middle if across else 0)


def _exact(threshold: float):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            ids, copies = np.asarray(rows.column("id")), np.asarray(rows.column("copies"))
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            found = np.zeros(len(ids), np.int64)
            low: list = [np.zeros(0, np.int64)]
            high: list = [np.zeros(0, np.int64)]
            for a, m, b in groups(rows):
                if m == a or b - a < 2:
                    continue
                left, right = _similar(sets[a:b], m - a, threshold)
                found[a:b] += (np.bincount(left, copies[a + right], b - a) + np.bincount(right, copies[a + left], b - a)).astype(np.int64)
                x, y = forest(b - a, left, right)
                low.append(ids[a + x])
                high.append(ids[a + y])
            low, high = np.concatenate(low), np.concatenate(high)
            none = np.zeros(len(low), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, low])), pa.array(np.concatenate([ids, high])), pa.array(np.concatenate([found, none]))], names=["id", "other", "links"]
            )

    return run


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            hashes, sizes = shingle_sets(texts, gram)
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("copies"), pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "copies", "shingles"]
            )

    return run


def _buckets(signed: DataFrame, split: int) -> DataFrame:
    """key, id, members: the buckets to compare, after splitting large ones as far as the levels go."""
    paths = signed.select("id", F.explode(F.arrays_zip("path_key", "path_run")).alias("p")).select(F.col("p.path_key").alias("key"), "id", F.col("p.path_run").alias("run"))
    more = signed.select("id", F.explode(F.arrays_zip("more_run", "more_level", "more_token")).alias("p")).select("id", F.col("p.more_run").alias("run"), F.col("p.more_level").alias("level"), F.col("p.more_token").alias("token"))
    settled = None
    for level in range(1, LEVELS + 1):
        met, _ = stored(shared_keys(paths), f"paths-{level}")
        done = met if level == LEVELS else met.where(F.col("members") <= split)
        done = done.select("key", "id", "members")
        settled = done if settled is None else settled.unionByName(done)
        large = met.where(F.col("members") > split)
        if level == LEVELS or large.limit(1).count() == 0:
            return settled
        paths = large.join(more.where(F.col("level") == level).drop("level"), ["id", "run"]).select(F.xxhash64("key", "token").alias("key"), "id", "run").distinct()
    return settled


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, split: int = SPLIT, sketch_block: int = SKETCH_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """One row a document: its id, class_id (least id with an equal set), component_id (least
    id reachable by links), n_links (others with a similarity of the threshold at least, equal
    ones included), n_shingles and kept (its id is component_id).

    Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased; a text of fewer
    words than gram, but not none, is one run. Null texts and texts without words have no set
    and link with nothing. Rows whose id is null are left out; ids must be unique. Other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = one_row_an_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"), "id")
    signed, signed_path = stored(source.mapInArrow(_sign(gram, threshold, runs_for(recall)), _SIGNED), "signed")
    sized, _ = stored(signed.select("id", "set_a", "set_b", "size"), "sized")
    equal, _ = stored(sized.where("size > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "equal")
    firsts = signed.join(equal.select(F.col("first").alias("id"), "copies").hint("merge"), "id")

    with scratch(spark):
        buckets = in_blocks(_buckets(firsts, split), sketch_block)
        release(spark)
        edges = meet(buckets.join(signed.select("id", "size", "sketch", "parity").hint("merge"), "id"), _sketch_edges(threshold), "a long, b long")
        edges, edge_path = stored_outside(edges.distinct(), "sketch-edges")
    drop_stored(spark, signed_path)
    release(spark)
    near = components(edges, "sketched")
    drop_stored(spark, edge_path)
    release(spark)

    with scratch(spark):
        members = near.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
        inside = in_blocks(near.join(members, "comp").select(F.col("comp").alias("key"), "id", "members"), set_block)
        wanted, _ = stored(near.select("id").join(equal.select(F.col("first").alias("id"), "copies"), "id"), "wanted")
        # Most texts are in no component. Spark's run-time Bloom filter (8 MB at most, and only while
        # the ids' table is small enough) drops them before the shuffle; what it lets through is joined.
        sets = source.join(wanted.where("copies > 0"), "id").mapInArrow(_sets(gram), "id long, copies long, shingles binary")
        bloom = "spark__sql__optimizer__runtime__bloomFilter__"
        with configured(spark, **{f"{bloom}enabled": "true", f"{bloom}applicationSideScanSizeThreshold": "0"}):
            compared, _ = stored_outside(meet(inside.join(sets, "id"), _exact(threshold), "id long, other long, links long"), "compared")
    release(spark)
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(compared.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), "linked")

    facts = equal.join(linked.withColumnRenamed("id", "first"), "first", "left").join(links.withColumnRenamed("id", "first"), "first", "left")
    of = sized.join(facts, ["set_a", "set_b"], "left")
    some = F.col("size") > 0
    component = F.when(some, F.coalesce("comp", "first")).otherwise(F.col("id"))
    return of.select(
        F.col("id").alias(id_col),
        F.when(some, F.col("first")).otherwise(F.col("id")).alias("class_id"),
        component.alias("component_id"),
        F.when(some, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.col("size").alias("n_shingles"),
        (component == F.col("id")).alias("kept"),
    )
