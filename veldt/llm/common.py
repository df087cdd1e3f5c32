"""What the text operators share: storage, sizing, word and window hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

MASK = (1 << 64) - 1


# ---------------------------------------------------------------- storage ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of tables to be deleted at the end of the innermost ``scratch`` blocks.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to a table in the shared folder and read it back: cuts the lineage and
    survives the loss of any executor. Inside ``scratch`` the table goes when that ends."""
    found = stored_outside(df, name)
    if _SCRATCH:
        _SCRATCH[-1].append(found[1])
    return found


def stored_outside(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``stored``, for a table that is read after the innermost ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldt-{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    if len(_SCRATCH) > 1:
        _SCRATCH[-2].append(path)
    return spark.read.schema(schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end: nothing that reads them may be left then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_stored(spark, path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver
    collects its garbage, which it may not do for long. What Python still names is kept."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextlib.contextmanager
def configured(spark: SparkSession, **settings: str):
    """Settings of the session (dots as double underscores) for what is run inside."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Bytes of an Arrow batch on its way to Python workers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send Python workers batches of a few megabytes, unless it names a size:
    with Spark's own of 64 MB a worker holds several times as much for texts alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ words ---


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = np.random.default_rng(20240229).integers(1, MASK, (2, 256), dtype=np.uint64, endpoint=True)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 of each."""
    if len(_POWERS["up"]) <= n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[s:e] for each pair: one prefix sum, then two lookups each."""
    up, down = _powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


#: Bytes hashed at a time: what a piece needs for a while is some thirty times as much.
PIECE = 1 << 19


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of data[s:e] for rising, disjoint pairs. kind: 0 or 1, for independent ones."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        out[i:j] = rolling(_BYTE_VALUES[kind][data[low : ends[j - 1]]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words: digits, letters and all that is not ASCII, once A-Z are lower-cased.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
SOLID = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """The words of some documents, hashed.

    texts: UTF-8 bytes, b'' for nulls. A word is a maximal run of bytes of ``kind``.
    start, end: byte positions in ``data``; doc: which text; hash: 64 bits, by bytes;
    first, count: of each text's words.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool):
        self.data = np.frombuffer(b" ".join(texts), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)])
        edge = np.diff(kind[self.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._hash: np.ndarray | None = None
        bounds = np.searchsorted(self.start, self.offset)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = byte_hashes(self.data, self.start, self.end)
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k consecutive words of one text."""
        if len(self) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[k - 1 :] == self.doc[: len(self) - k + 1])
        return at, rolling(self.hash, at, at + k)

    def of(self, i: int) -> bytes:
        return self.data[self.offset[i] : self.offset[i + 1] - 1].tobytes()


#: What operators keep in a worker from task to task, by operator.
LEARNED: dict[str, dict] = {}


def learned(operator: str) -> dict:
    return LEARNED.setdefault(operator, {})


#: Slices of texts, or tables of groups, after which a worker gives back the memory it has freed.
_TIDY = 16


def tidy() -> None:
    """Give freed memory back to the system: else a worker holds its highest use for good."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20, operator: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each, and those texts.

    A worker that turns to another operator forgets what the one before has learned.
    """
    for other in set(LEARNED) - {operator}:
        del LEARNED[other]
    given = 0
    for batch in batches:
        values = batch.column(column).cast(pa.large_binary())
        sizes = np.array(values.value_lengths().fill_null(0)) if hasattr(values, "value_lengths") else np.array(pa.compute.binary_length(values).fill_null(0))
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(total, most, side="right")))
            part = batch.slice(at, n)
            yield part, [x or b"" for x in values.slice(at, n).to_pylist()]
            at += n
            given += 1
            if given % _TIDY == 0:
                tidy()
    tidy()


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers by byte significance, so that the shuffle's compressor sees runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000, size: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys: of about ``rows`` rows or ``size``
    bytes, and more only where one group has more."""
    held: list[pa.RecordBatch] = []
    count = weight = 0
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [np.asarray(batch.column(k)) for k in keys]
        if first is None:
            first = [v[0] for v in values]
        held.append(batch)
        count += batch.num_rows
        weight += batch.get_total_buffer_size()
        last = [v[-1] for v in values]
        if (count < rows and weight < size) or last == first:
            continue
        # The last group may go on in the next batch.
        same = np.logical_and.reduce([v == x for v, x in zip(values, last, strict=True)])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(cut)]
        else:
            # The group began in an earlier batch; what is before it goes out with the batches that hold it alone kept.
            whole = pa.Table.from_batches(held).combine_chunks()
            before = np.logical_and.reduce([np.asarray(whole.column(k)) == x for k, x in zip(keys, last, strict=True)])
            cut = int(np.flatnonzero(~before)[-1]) + 1
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
        count = sum(b.num_rows for b in held)
        weight = sum(b.nbytes for b in held)
        first = last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held.clear()
    tidy()


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Where the groups of sorted columns begin, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def one_row_an_id(df: DataFrame, id_col: str) -> DataFrame:
    """df, with one row for each id: of rows that share an id, the least by its other columns.

    Only ids are counted in a shuffle; where none repeats, df is given back as it is, and
    otherwise only the rows of repeated ids are compared.
    """
    again = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    if not again.limit(1).count():
        return df
    rest = [c for c in df.columns if c != id_col]
    least = df.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(*rest)).alias("least"))
    return df.join(again, id_col, "left_anti").select(df.columns).unionByName(least.select(id_col, *(F.col("least")[c].alias(c) for c in rest)))


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n
