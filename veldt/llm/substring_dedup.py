"""Exact removal of repeated passages.

Every window of ``width`` consecutive words is given two Rabin-Karp hashes. Windows are
counted by hash in Spark; all but the earliest occurrence (smallest doc_id, then smallest
start) are marked, and marked windows merge into maximal removal intervals of each document.

Plan: documents are read in blocks of some million windows. Of the windows that repeat
inside a block only the earliest is sent on, so a passage of a third of all documents sends
one hash a block, not one a document; where the others stand is known to repeat, and goes
straight to the block's own intervals. What is sent travels as packed arrays, about nine
bytes a window, dealt by the second hash to buckets. Buckets that would hold more than some
million windows are split again on arrival, so what a task holds is bounded by parameters
and by the number of blocks, whatever the input. Marked positions return to their block,
become intervals there, and are joined to the documents by id.

Two different windows are taken for one if their first hashes (64 bits) agree and the second
ones fall into one bucket; with n buckets that has a probability of 2**-64 / n a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, Words, group_bounds, mix, one_row_an_id, partitions, planes, release, rolling, small_batches, stored, text_batches, unplanes, whole_groups

WIDTH = 20
#: Windows of a block, and of a bucket on average at most.
BLOCK_WINDOWS = 1_000_000
BUCKET_WINDOWS = 4_000_000
#: Bytes of a word and the blank behind it, at least, by which windows are estimated from a text's size.
_WORD_BYTES = 4

#: To a bucket: hashes and where their windows start. To a block (bucket below 0): runs of windows already known to repeat.
_SENT = "bucket long, part int, block long, hashes binary, docs binary, starts binary, runs binary"
_MARKED = "block long, docs binary, starts binary, runs binary"
_INTERVALS = "of_doc long, intervals binary"


def _pack(docs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    """Positions in order, as differences."""
    step = np.diff(docs, prepend=0)
    begin = starts.copy()
    begin[1:] -= np.where(step[1:] == 0, starts[:-1], 0)
    return planes(step.astype(np.int64)), planes(begin.astype(np.uint32))


def _unpack(docs: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    step = unplanes(docs, np.int64)
    begin = unplanes(starts, np.uint32).astype(np.int64)
    if not len(step):
        return step, begin
    total = np.cumsum(begin)
    new = np.flatnonzero(np.concatenate([[True], step[1:] != 0]))
    size = np.diff(np.append(new, len(step)))
    return np.cumsum(step), total - np.repeat(total[new] - begin[new], size)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _runs(docs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ordered windows as packed runs of consecutive starts."""
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(fresh)
    return *_pack(docs[at], starts[at]), planes(np.diff(np.append(at, len(docs))).astype(np.uint32))


def _windows_of(width: int, buckets: int, block: int):
    def send(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, g, d, s = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(d, kind="stable")  # each document's windows are in order already
        h, g, d, s = h[order], g[order], d[order], s[order]
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        first = np.ones(len(h), bool)
        if len(twice):
            twice = np.unique(twice)
            near = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            some = np.flatnonzero(twice[near] == h)
            order = some[np.argsort(h[some], kind="stable")]
            first[order[1:][h[order[1:]] == h[order[:-1]]]] = False
            yield _batch([(-1 - number, 0, number, b"", *_runs(d[~first], s[~first]))], _SENT)
        first = np.flatnonzero(first)
        first = first[np.argsort(g[first], kind="stable")]
        h, g, d, s = h[first], g[first], d[first], s[first]
        bounds = group_bounds(g).tolist()
        rows, size = [], 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows.append((int(g[a]), 0, number, h[a:b].tobytes(), *_pack(d[a:b], s[a:b]), b""))
            size += b - a
            if size > 1 << 18:
                yield _batch(rows, _SENT)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32  # short numbers are sorted faster
        number, count = TaskContext.get().partitionId() << 32, 0
        for part, texts in text_batches(batches):
            words = Words(texts, SOLID, lower=False)
            at, h = words.windows(width)
            if not len(at):
                continue
            g = rolling(mix(words.hash + np.uint64(1)), at, at + width) % np.uint64(buckets)
            ids = np.asarray(part.column("of_doc").to_numpy(zero_copy_only=False), np.int64)
            doc = words.doc[at]
            start = (at - words.first[doc]).astype(np.uint32)
            for a in range(0, len(at), block):
                b = min(len(at), a + block)
                held.append((h[a:b], g[a:b].astype(kind), ids[doc[a:b]], start[a:b]))
                count += b - a
                if count >= block:
                    yield from send(number, held)
                    number, count = number + 1, 0
        if count:
            yield from send(number, held)

    return run


def _split(parts: int, most: int):
    """A bucket's windows by the low bits of their hash, so many rows together that the parts aren't tiny."""

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, block, h, d, s in held:
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((s, d, part))
            bounds = group_bounds(part[order]).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[a:b]
                rows.append((bucket, int(part[own[0]]), block, h[own].tobytes(), *_pack(d[own], s[own]), b""))
        held.clear()
        yield _batch(rows, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            yield batch.filter(pa.compute.less(batch.column("bucket"), 0))
            for row in batch.filter(pa.compute.greater_equal(batch.column("bucket"), 0)).to_pylist():
                h = np.frombuffer(row["hashes"], np.uint64)
                held.append((row["bucket"], row["block"], h, *_unpack(row["docs"], row["starts"])))
                count += len(h)
                if count > most:
                    yield from emit(held)
                    count = 0
        if held:
            yield from emit(held)

    return run


def _marked(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's equal hashes, all but the earliest, to their blocks."""
    for rows in tables:
        bucket, part, block = (np.asarray(rows.column(k)) for k in ("bucket", "part", "block"))
        known = np.flatnonzero(bucket < 0)
        if len(known):
            yield pa.RecordBatch.from_struct_array(rows.select(["block", "docs", "starts", "runs"]).take(known).to_struct_array().combine_chunks())
        bounds = group_bounds(bucket, part).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if bucket[a] < 0 or b - a < 2:
                continue  # a block's own hashes differ
            own = [rows.column(k).slice(a, b - a).to_pylist() for k in ("hashes", "docs", "starts")]
            h = np.frombuffer(b"".join(own[0]), np.uint64)
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            if not same.any():
                continue
            # Only what shares its hash is unpacked in full order.
            keep = np.zeros(len(h), bool)
            keep[order[1:][same]] = True
            keep[order[:-1][same]] = True
            size = np.fromiter(map(len, own[0]), np.int64, b - a) // 8
            end = np.cumsum(size)
            at = np.flatnonzero(keep)
            places = [_unpack(x, y) for x, y in zip(own[1], own[2], strict=True)]
            d, s = (np.concatenate([p[i] for p in places])[at] for i in (0, 1))
            h, of = h[at], block[a:b][np.searchsorted(end, at, side="right")]
            order = np.lexsort((s, d, h))
            again = order[1:][h[order[1:]] == h[order[:-1]]]
            again = again[np.lexsort((s[again], d[again], of[again]))]
            d, s, of = d[again], s[again], of[again]
            cut = group_bounds(of).tolist()
            yield _batch([(int(of[i]), *_runs(d[i:j], s[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)], _MARKED)


def _intervals_of(width: int):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            bounds = group_bounds(np.asarray(rows.column("block"))).tolist()
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                own = rows.slice(i, j - i).to_pydict()
                parts = [(*_unpack(x, y), unplanes(z, np.uint32).astype(np.int64)) for x, y, z in zip(own["docs"], own["starts"], own["runs"], strict=True)]
                d, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((s, d))
                d, s, n = d[order], s[order], n[order]
                end = s + n - 1 + width
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (s[1:] > end[:-1])  # a block's runs don't overlap, so ends rise
                last = np.append(fresh[1:], True)
                begin, end, doc = s[fresh], end[last], d[fresh]
                cut = group_bounds(doc).tolist()
                pairs = np.stack([begin, end], 1).astype(np.int64)
                yield _batch([(int(doc[a]), pairs[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], _INTERVALS)

    return run


def _intervals(source: DataFrame, width: int, block_windows: int, bucket_windows: int) -> DataFrame:
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes")).collect()[0].bytes or 0
    # So many that the tasks get about the same, but a block sends each bucket a row, and none should be tiny.
    buckets = max(1, min(16 * partitions(spark), block_windows // 16))
    parts = max(1, -(-(size // _WORD_BYTES) // (buckets * bucket_windows)))
    sent = source.mapInArrow(_windows_of(width, buckets, block_windows), _SENT).repartition("bucket")
    if parts > 1:
        sent = sent.mapInArrow(_split(parts, bucket_windows), _SENT)
    marked = sent.sortWithinPartitions("bucket", "part").mapInArrow(lambda b: _marked(whole_groups(b, ["bucket", "part"])), _MARKED)
    return marked.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _intervals_of(width)(whole_groups(b, ["block"])), _INTERVALS)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return one_row_an_id(docs.select(F.col(id_col).cast("long").alias("of_doc"), F.col(text_col).alias("text")).where("of_doc is not null"), "of_doc")


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """of_doc, intervals: little-endian int64 pairs (first word, end word), in order.

    Only documents with something to remove have rows; a document of more windows than a
    block has several, whose intervals may touch or overlap. Nulls, empty texts and texts of
    fewer than ``width`` words have no windows. Rows without an id are left out; rows that
    share an id are one document, with the least of their texts.
    """
    return _intervals(_source(docs, id_col, text_col), width, block_windows, bucket_windows)


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        n_words, n_removed, kept, digest = [], [], [], []
        for text, spans in zip(texts, part.column("intervals").to_pylist(), strict=True):
            words = text.split()  # bytes.split() parts at the six ASCII white-space bytes only
            n_words.append(len(words))
            if spans:
                left, at = [], 0
                for a, b in sorted(np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()):
                    left += words[at : max(a, at)]
                    at = max(b, at)
                words = left + words[at:]
            joined = b" ".join(words)
            n_removed.append(n_words[-1] - len(words))
            digest.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                kept.append(joined)
        arrays = [part.column("of_doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["of_doc", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = True, block_windows: int = BLOCK_WINDOWS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row a document: its id, n_words, n_removed, kept_sha256 and, unless keep_text
    is False, kept_text (kept words joined by one blank).

    Words are runs of anything but ASCII white space, unchanged. Windows are judged on the
    input: a window goes if its words also start earlier, in a document of smaller id or
    further left, and with it all of its words. A null or empty text has no words and the
    hash of the empty string. Rows that share an id are one document, with the least of
    their texts, and have one row, so a row repeated isn't a repetition of its own words.
    Rows whose id is null can't be ordered and are left out. Other columns of docs are
    ignored whatever their names. An empty table gives no rows.
    """
    source = _source(docs, id_col, text_col)
    found, _ = stored(_intervals(source, width, block_windows, bucket_windows), "intervals")
    release(docs.sparkSession)
    # A document of several blocks has several rows of intervals, one after the other in one string of bytes.
    found = found.groupBy("of_doc").agg(F.array_join(F.collect_list(F.hex("intervals")), "").alias("hex")).select("of_doc", F.unhex("hex").alias("intervals"))
    schema = "of_doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return source.join(found, "of_doc", "left").mapInArrow(lambda b: _cut(b, keep_text), schema).withColumnRenamed("of_doc", id_col)
