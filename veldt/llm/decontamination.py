"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed in runs of ``gram`` words; of every
``window - gram + 1`` consecutive runs, that is in every window of ``window`` words, the
one with the smallest hash (the rightmost of equals) is kept as a fingerprint. What is
kept in a window depends on its words alone, so documents and items that share a window
share a fingerprint at the same place of it. Fingerprints are joined; each hit is extended
word by word to the left and right, up to one window's length, and counts where the match
is at least a window long. Items shorter than a window are matched as a whole, by the hash
of all their words, and compared word by word too.

A document's fingerprint is shuffled only if it may be one of the benchmark's. That is
decided by a bit array whose size is fixed, whatever the size of either side: a large
benchmark makes it let more pass, never less.

A passage may be in a third of all documents, so its fingerprints are a hot key of the join
on the side of the documents. Spark splits such a partition at run time (adaptive skew
join); the other side holds one row for each fingerprint and different context, whatever
the number of items that share it. Where a text holds a short item many times, one row has
all the places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, group_bounds, mix, one_row_an_id, rolling, small_batches, stored, text_batches, whole_groups

WINDOW = 10
GRAM = 5
#: Bits of the pre-filter: 1 MB, sent to every executor.
FILTER_BITS = 1 << 23

#: need: how many words a match must have.
_PRINTS = "key long, of_id long, at binary, back int, ahead binary, need int"


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each fingerprint: of every window, the rightmost smallest run."""
    at, h = words.windows(gram)
    span = window - gram + 1
    if len(at) < span:
        return at[:0], h[:0]
    n = len(h) - span + 1
    best, pick = h[span - 1 :].copy(), np.arange(span - 1, len(h))
    for j in range(span - 2, -1, -1):
        less = np.flatnonzero(h[j : j + n] < best)
        best[less] = h[j : j + n][less]
        pick[less] = less + j
    ok = at[span - 1 :] - at[: len(at) - span + 1] == span - 1
    ok &= words.doc[at[span - 1 :]] == words.doc[at[: len(at) - span + 1]]
    pick = np.unique(pick[ok])
    return at[pick], h[pick]


def _rows(words: Words, ids: np.ndarray, at: np.ndarray, key: np.ndarray, before: int, after: int) -> pa.RecordBatch:
    """Fingerprints with the words around them: of each, ``before`` to the left and ``after`` from it on, as far as the text goes."""
    doc = words.doc[at]
    first = words.first[doc]
    low = np.maximum(at - before, first)
    high = np.minimum(at + after, first + words.count[doc])
    return _batch(words, ids[doc], [x.tobytes() for x in (at - first)[:, None]], key, at - low, low, high, after)


def _batch(words: Words, ids: np.ndarray, at: list[bytes], key: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray, need: int) -> pa.RecordBatch:
    context = [b" ".join([words.data[words.start[i] : words.end[i]].tobytes() for i in range(a, b)]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(at, pa.binary()), pa.array(back, pa.int32()), pa.array(context, pa.binary()), pa.array(np.full(len(context), need, np.int32))],
        names=["key", "of_id", "at", "back", "ahead", "need"],
    )


def _short_rows(words: Words, ids: np.ndarray, at: np.ndarray, key: np.ndarray, n: int) -> pa.RecordBatch:
    """Runs of n words, with all their places in a text in one row."""
    doc = words.doc[at]
    size = words.end[at + n - 1] - words.start[at]
    order = np.lexsort((at, size, key, doc))
    at, doc, key, size = at[order], doc[order], key[order], size[order]
    bounds = group_bounds(doc, key, size)
    own = at[bounds[:-1]]
    place = at - words.first[doc]
    places = [place[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return _batch(words, ids[doc[bounds[:-1]]], places, key[bounds[:-1]], np.zeros(len(own), np.int64), own, own + n, n)


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("of_id").to_numpy(zero_copy_only=False), np.int64)


def _item_prints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            words, ids = Words(texts, ALNUM, lower=True), _ids(part)
            at, key = fingerprints(words, window, gram)
            yield _rows(words, ids, at, key, window - gram, window)
            for n in range(1, window):
                short = words.first[words.count == n]
                if len(short):
                    yield _short_rows(words, ids, short, _whole(words, short, n), n)

    return run


def _whole(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of n words from each place on, apart from those of other lengths."""
    return mix(rolling(words.hash, at, at + n) + np.uint64(n))


def _doc_prints(window: int, gram: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, short = sent.value
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").view(bool)
        mask = np.uint64(len(bits) - 1)
        for part, texts in text_batches(batches):
            words, ids = Words(texts, ALNUM, lower=True), _ids(part)
            at, key = fingerprints(words, window, gram)
            may = bits[key & mask]
            if may.any():
                yield _rows(words, ids, at[may], key[may], window - gram, window)
            for n in short:
                at, _ = words.windows(n)
                key = _whole(words, at, n)
                may = bits[key & mask]
                if may.any():
                    yield _short_rows(words, ids, at[may], key[may], n)

    return run


def _bits_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            key = np.asarray(batch.column("key")).view(np.uint64)
            bits[key & np.uint64(size - 1)] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed[at])], names=["word", "bits"])

    return run


def _reach(text: bytes, back: int, other: bytes, other_back: int) -> tuple[int, int]:
    """How many words agree to the left of two places, and from them on."""
    a, b = text.split(b" "), other.split(b" ")
    left = 0
    while left < min(back, other_back) and a[back - left - 1] == b[other_back - left - 1]:
        left += 1
    right = 0
    while right < min(len(a) - back, len(b) - other_back) and a[back + right] == b[other_back + right]:
        right += 1
    return left, right


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: a document's and items' fingerprints with equal key. Gives the matched stretch of at
    least a window, or the whole of a shorter item. Equal pairs of contexts are compared once a batch."""
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("of_doc", "at", "back", "ahead", "of_items", "item_back", "item_ahead", "need")}
        known: dict[tuple, tuple[int, int]] = {}
        out: list[tuple] = []
        for doc, at, back, text, items, item_back, item_text, n in zip(*cols.values(), strict=True):
            pair = (text, back, item_text, item_back)
            if pair not in known:
                known[pair] = _reach(*pair)
            left, right = known[pair]
            if left + right >= n:
                out += [(doc, item, p - left, p + right) for p in np.frombuffer(at, np.int64).tolist() for item in items]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["of_doc", "item", "begin", "finish"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        words = Words(texts, ALNUM, lower=True)
        yield pa.RecordBatch.from_arrays([part.column("of_id"), pa.array(words.count, pa.int64())], names=["of_id", "n_words"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words covered by a document's stretches, its stretches in order of begin."""
    for rows in whole_groups(batches, ["of_doc"]):
        doc, begin, finish = (np.asarray(rows.column(k)) for k in ("of_doc", "begin", "finish"))
        bounds = group_bounds(doc)
        covered = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            reach = np.maximum.accumulate(finish[a:b])
            low = np.maximum(begin[a:b], np.concatenate([[0], reach[:-1]]))
            covered.append(int(np.maximum(reach - low, 0).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]], pa.int64()), pa.array(covered, pa.int64())], names=["of_doc", "n_hit"])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Matched stretches: of_doc, item, begin, finish (words; finish exclusive), each at least
    one window long or a whole shorter item. Together they cover exactly the words that lie in
    some occurrence of a window. Stretches may repeat and overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    of_items = items.select(F.col(item_id).cast("long").alias("of_id"), F.col(text_col).alias("text")).where("of_id is not null")
    of_docs = docs.select(F.col(doc_id).cast("long").alias("of_id"), F.col(text_col).alias("text")).where("of_id is not null")
    prints = of_items.mapInArrow(_item_prints(window, gram), _PRINTS)
    # The bit array's size is fixed: FILTER_BITS / 64 words at most, whatever the benchmark.
    words = prints.mapInArrow(_bits_of(FILTER_BITS), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    raw = np.zeros(FILTER_BITS // 64, np.int64)
    raw[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    short = sorted(r.need for r in prints.where(F.col("need") < window).select("need").distinct().collect())
    sent = spark.sparkContext.broadcast((raw.tobytes(), short))
    left = of_docs.mapInArrow(_doc_prints(window, gram, sent), _PRINTS).select("key", F.col("of_id").alias("of_doc"), "at", "back", "ahead")
    right = prints.groupBy("key", "need", F.col("back").alias("item_back"), F.col("ahead").alias("item_ahead")).agg(F.collect_set("of_id").alias("of_items"))
    pairs = left.join(right.hint("merge"), "key").select("of_doc", "at", "back", "ahead", "of_items", "item_back", "item_ahead", "need")
    return pairs.mapInArrow(_extend, "of_doc long, item long, begin long, finish long")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row a document: its id, n_words, n_hit (words inside an occurrence of a window),
    items (array of the ids of items with an occurring window, sorted as strings).

    Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased. Null or empty
    texts have no words and match nothing; an item of 1 to window - 1 words is one window,
    one without words none. Items that share an id are one item with all of their windows;
    documents that share an id are one, with the least of their texts. Rows whose id is null
    are left out; other columns are ignored whatever their names. Empty tables on either
    side give zeros, or no rows.
    """
    small_batches(docs.sparkSession)
    of_docs = one_row_an_id(docs.select(F.col(doc_id).cast("long").alias("of_id"), F.col(text_col).alias("text")).where("of_id is not null"), "of_id")
    of_items = items.select(F.col(item_id).alias("of_id"), F.col(text_col).alias("text"))
    found, _ = stored(overlaps(of_docs, of_items, "of_id", "of_id", "text", window, gram).distinct(), "overlaps")
    hits = found.select("of_doc", "begin", "finish").distinct().repartition("of_doc").sortWithinPartitions("of_doc", "begin").mapInArrow(_union, "of_doc long, n_hit long")
    which = found.select("of_doc", "item").distinct().groupBy("of_doc").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    counted = of_docs.mapInArrow(_count, "of_id long, n_words long").withColumnRenamed("of_id", "of_doc")
    return (
        counted.join(hits.join(which, "of_doc"), "of_doc", "left")
        .select(F.col("of_doc").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
