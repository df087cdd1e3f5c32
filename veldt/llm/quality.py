"""A byte-level convolutional network that scores the quality of whole texts.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it; a last short
chunk is padded. Each byte is embedded, learned filters run over the chunk, and each
filter's largest response is kept. Over a text's chunks the responses are combined by
mean, maximum and minimum; a small hidden layer makes one probability of them.

The network is trained here, in numpy, on a bounded sample of labelled rows; scoring is
one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

#: Bytes of a chunk, and of the overlap of two: one less than a filter's width, so that no place is left out.
CHUNK = 256
TAPS = 10
EMBED = 4
FILTERS = 24
HIDDEN = 16
STRIDE = 2
#: Labelled rows used for training at most, of label 0 and of label 1.
TRAIN_ROWS = (1500, 1500)
ROUNDS = 700
BATCH = 48


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED, the last for padding
    filters: np.ndarray  # TAPS * EMBED x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 3 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return list(vars(self).values())


def chunks(text: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Overlapping chunks of a text, bytes as 0 to 255 and padding as 256."""
    step = chunk - (TAPS - 1)
    n = max(1, -(-(len(text) - (TAPS - 1)) // step))
    flat = np.full((n - 1) * step + chunk, 256, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, chunk)[::step]


def _patches(net: Network, x: np.ndarray) -> np.ndarray:
    """chunks x places x TAPS * EMBED."""
    e = net.embed[x]
    places = (x.shape[1] - TAPS) // STRIDE + 1
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (len(x), places, TAPS * EMBED), (s[0], STRIDE * s[1], s[2]))


def responses(net: Network, x: np.ndarray) -> np.ndarray:
    """chunks x places x FILTERS."""
    return (np.ascontiguousarray(_patches(net, x)).reshape(-1, TAPS * EMBED) @ net.filters).reshape(len(x), -1, FILTERS)


def pooled(net: Network, x: np.ndarray) -> np.ndarray:
    """chunks x FILTERS: each filter's largest response in each chunk."""
    if not len(x):
        return np.zeros((0, FILTERS), net.filters.dtype)
    return np.maximum(responses(net, x).max(1) + net.bias, 0)


def combine(net: Network, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, hidden values and scores of texts whose chunks begin at first."""
    count = np.diff(np.append(first, len(top)))[:, None]
    features = np.concatenate([np.add.reduceat(top, first) / count, np.maximum.reduceat(top, first), np.minimum.reduceat(top, first)], 1)
    h = np.maximum(features @ net.hidden + net.hidden_bias, 0)
    z = np.clip(h @ net.out + net.out_bias, -30, 30)
    return features, h, 1 / (1 + np.exp(-z))


def score(net: Network, texts: list[bytes], piece: int = 1024) -> np.ndarray:
    """Probabilities of label 1, one for each text."""
    cut = [chunks(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])[:-1].astype(np.int64)
    every = np.concatenate(cut)
    top = np.concatenate([pooled(net, every[i : i + piece]) for i in range(0, len(every), piece)])
    return combine(net, top, first)[2].astype(np.float64)


def gradients(net: Network, x: np.ndarray, size: np.ndarray, y: np.ndarray, piece: int = 128) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of texts of so many chunks each, and its gradients in the order of parts()."""
    first = np.cumsum(size) - size
    at, raw = [], []
    for i in range(0, len(x), piece):
        response = responses(net, x[i : i + piece])
        at.append(response.argmax(1))
        raw.append(np.take_along_axis(response, at[-1][:, None], 1)[:, 0])
    at, raw = np.concatenate(at), np.concatenate(raw) + net.bias
    top = np.maximum(raw, 0)
    features, h, p = combine(net, top, first)
    loss = -float(np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
    dz = ((p - y) / len(y)).astype(top.dtype)
    dh = np.outer(dz, net.out) * (h > 0)
    df = dh @ net.hidden.T
    owner = np.repeat(np.arange(len(size)), size)
    dtop = df[owner, :FILTERS] / size[owner, None]
    for k in (1, 2):  # maximum and minimum
        hit = top == features[owner, k * FILTERS : (k + 1) * FILTERS]
        dtop += hit / np.maximum(np.add.reduceat(hit, first, dtype=np.int64)[owner], 1) * df[owner, k * FILTERS : (k + 1) * FILTERS]
    dtop = (dtop * (raw > 0)).astype(top.dtype)
    # Only the best place of each filter in each chunk has a part in the loss.
    g_filters, g_embed = np.zeros_like(net.filters), np.zeros((257, EMBED))
    for i in range(0, len(x), piece):
        own, d = slice(i, i + piece), dtop[i : i + piece]
        place = (at[own] * STRIDE)[:, :, None] + np.arange(TAPS)
        byte = x[own][np.arange(len(d))[:, None, None], place]  # chunks x FILTERS x TAPS
        g_filters += np.einsum("cfk,cf->kf", net.embed[byte].reshape(*d.shape, -1), d)
        spread = (d[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        flat = byte.reshape(-1)
        g_embed += np.stack([np.bincount(flat, spread[:, e], 257) for e in range(EMBED)], 1)
    return loss, [g_embed.astype(top.dtype), g_filters, dtop.sum(0), features.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Adam on the cross entropy of batches of whole texts with both labels alike."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(
        rng.normal(0, 0.5, (257, EMBED)).astype(f32),
        rng.normal(0, 1 / np.sqrt(TAPS * EMBED), (TAPS * EMBED, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32),
        rng.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)).astype(f32),
        np.zeros(HIDDEN, f32),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(f32),
        np.zeros(1, f32),
    )
    of = [np.flatnonzero(labels == v) for v in (0, 1)]
    if not len(of[0]) or not len(of[1]):
        net.out[:] = 0
        net.out_bias[:] = -3 if len(of[0]) else 3  # without any labels as if all were 1
        return net
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for turn in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(o, BATCH // 2) for o in of])
        some = [chunks(texts[i]) for i in pick]
        _, found = gradients(net, np.concatenate(some), np.array([len(c) for c in some]), labels[pick])
        rate = 0.01 * min(1, turn / 30) * (1 - turn / (rounds + 1)) + 1e-4
        for i, (p_, g) in enumerate(zip(net.parts(), found, strict=True)):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p_ -= rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, allowed, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: tuple[int, int] = TRAIN_ROWS, sent=None) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled rows of each label, by the hash of their id. allowed: condition on the label rows.

    sent: what executors make of a list of texts for the driver; whole texts by default.
    rows bounds how many come to the driver and are sent for the join. Rows of labels that
    share an id count as one, with the larger label; labels other than 0 and 1 and null ids
    don't count; without labels, documents or both there is nothing to learn from.
    """
    known = labels.where(allowed).where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("of_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).where("of_id is not null")
    some = [known.where(F.col("label") == v).orderBy(F.xxhash64("of_id"), "of_id").limit(rows[v]) for v in (0, 1)]
    picked = [(r.of_id, r.label) for r in some[0].unionByName(some[1]).collect()]
    # As an Arrow table, for which Spark starts no Python workers.
    chosen = docs.sparkSession.createDataFrame(pa.table({"of_id": pa.array([i for i, _ in picked], pa.int64()), "label": pa.array([v for _, v in picked], pa.int32())}))
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("of_id"), F.col(text_col).alias("text"))
    found = source.join(F.broadcast(chosen), "of_id").select("of_id", "label", "text").mapInArrow(_training_texts(sent or list), "of_id long, label int, text binary").collect()
    found.sort(key=lambda r: (r.of_id, r.text))
    return [bytes(r.text) for r in found], np.array([r.label for r in found], np.int64)


def _training_texts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("of_id"), part.column("label"), pa.array(sent(texts), pa.binary())], names=["of_id", "label", "text"])

    return run


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("of_id"), pa.array(score(net, texts))], names=["of_id", "score"])

    return run


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and score (0 to 1; higher: label 1 is likelier).

    A null or empty text is one chunk of padding and has a score too. Repeated rows are
    scored each; a null id stays null; other columns are ignored whatever their names; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(F.col(id_col).cast("long").alias("of_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_scores(sent), "of_id long, score double").withColumnRenamed("of_id", id_col)


def _passing(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part, texts in text_batches(batches):
            yield part.filter(pa.array(score(net, texts) >= least))

    return run


def passing(docs: DataFrame, net: Network, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text column scores ``least`` or more. Null and
    empty texts are scored as one chunk of padding; every row, repeated or not, is judged by itself."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_passing(sent, least), docs.schema)
