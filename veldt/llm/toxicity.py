"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel counts the common subsequences of three characters of two strings, each
weighted by a decay to the power of the stretch it spans, so characters that are inserted
into a word or dropped from it lower the kernel but don't break it. It is approximated by
Nystrom's method on a few landmark strings; a linear machine is trained on those features.

Because the kernel has an explicit, finite map (one weight for each triple of symbols),
the machine's expansion over the landmarks folds into one table of triples, and a string
is scored by summing the table over its own triples.

A text is cut into units: words, with signs kept inside them, and runs of single
characters ("i d i o t") as one unit; long units are read in overlapping stretches. Texts
bear the labels, units don't: training starts from units much more frequent in toxic
texts, and then takes each toxic text's highest unit as its positive example. A text's
probability comes from its highest unit.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learned, mix, small_batches, text_batches

DECAY = 0.8
#: Characters of a stretch at most, and how far the next begins.
REACH, STEP = 16, 8
LANDMARKS = 160
#: Labelled rows used for training at most, clean and toxic.
TRAIN_ROWS = (5000, 2000)
NEGATIVES = 6000
ROUNDS = 2
#: Distinct units a worker remembers the value of.
MEMO_UNITS = 400_000

#: 0 stands for a sign, 1 for a digit, 2 for any other letter.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
SYMBOLS = len(_LETTERS) + 3
_CODES = np.array([_LETTERS.index(c) + 3 if c in _LETTERS else 1 if c.isdigit() else 2 if c.isalpha() else 0 for c in map(chr, range(0x250))], np.int32)
_ENDS = ".,;:!?\"'()[]{}<>*&%$#|-_/\\"


def units(text: str) -> set[str]:
    """The distinct units of a text, lower-cased, composed, without signs at their ends."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    words = text.split()
    found = {u.strip(_ENDS) for u in set(words)}
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    edge = np.diff(single.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 3
    found.update("".join(words[i:j]) for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True))
    found.update("".join(filter(str.isalnum, u)) for u in [u for u in found if not u.isalnum()])
    found.discard("")
    return found


def stretches(unit: str) -> list[str]:
    if len(unit) <= REACH:
        return [unit]
    return [unit[i : i + REACH] for i in range(0, len(unit) - STEP, STEP)]


def bag(text: str) -> list[str]:
    """The distinct units of a text, long ones by their stretches, in order."""
    return sorted({s for u in units(text) for s in stretches(u)})


def sent_bags(texts: list[bytes]) -> list[bytes]:
    """Texts' bags on their way to the driver, one string a line; none holds a line's end."""
    return ["\n".join(bag(str(t, "utf-8", "replace"))).encode() for t in texts]


def received_bags(lines: list[bytes]) -> list[list[str]]:
    return [t.decode().split("\n") if t else [] for t in lines]


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def feature_cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of one length, as symbols: the table cell of each triple, and its weight."""
    at, weight = _triples(codes.shape[1])
    return (codes[:, at[:, 0]] * SYMBOLS + codes[:, at[:, 1]]) * SYMBOLS + codes[:, at[:, 2]], weight


@lru_cache(maxsize=64)
def _scale(n: int) -> float:
    """The kernel is divided by this for each of its two strings: the norm of a string of that
    length whose characters all differ. Scaling by a function of one string keeps it a kernel."""
    return float(np.sqrt((_triples(n)[1].astype(np.float64) ** 2).sum()))


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the strings of each length of at least three, and their symbols."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(size[size >= 3]).tolist():
        at = np.flatnonzero(size == n)
        for part in np.array_split(at, len(at) * len(_triples(n)[1]) // 500_000 + 1):
            points = np.frombuffer("".join([strings[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 2).astype(np.int32).reshape(-1, n)


def dense(strings: list[str]) -> np.ndarray:
    """Explicit feature vectors, for landmarks."""
    out = np.zeros((len(strings), SYMBOLS**3), np.float32)
    for at, codes in by_length(strings):
        cells, weight = feature_cells(codes)
        for row, own in zip(at, cells, strict=True):
            out[row] = np.bincount(own, weight, SYMBOLS**3) / _scale(codes.shape[1])
    return out


@dataclass
class Machine:
    table: np.ndarray  # a weight for each triple: the expansion over the landmarks
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def name(self) -> str:
        """A digest of what gives strings their values."""
        return sha256(self.table.tobytes() + np.float64(self.bias).tobytes()).hexdigest()

    def values(self, strings: list[str]) -> np.ndarray:
        """The machine's value of each string; strings of fewer than three characters have the bias."""
        out = np.full(len(strings), self.bias, np.float32)
        for at, codes in by_length(strings):
            cells, weight = feature_cells(codes)
            out[at] += (self.table[cells] @ weight) / np.float32(_scale(codes.shape[1]))
        return out

    def unit_values(self, found: list[str]) -> np.ndarray:
        cut = [stretches(u) for u in found]
        flat = self.values([s for c in cut for s in c])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.maximum.reduceat(flat, np.cumsum(size) - size) if len(cut) else flat

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def _products(strings: list[str], marks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each string with each landmark."""
    out = np.zeros((len(strings), len(marks)), np.float32)
    turned = np.ascontiguousarray(marks.T)
    for at, codes in by_length(strings):
        cells, weight = feature_cells(codes)
        for row, own in zip(at, cells, strict=True):
            out[row] = weight @ turned[own] / np.float32(_scale(codes.shape[1]))
    return out


def _linear(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, epochs: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine, both classes weighing alike, by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = z = np.zeros(x.shape[1])
    step = 1 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + strength)
    for turn in range(epochs * 10):
        slack = np.maximum(1 - y * (x @ z), 0)
        after = z - step * (-2 * x.T @ (weight * y * slack) + strength * z)
        z = after + turn / (turn + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def pivots(strings: list[str], most: int, least: float = 0.02) -> list[str]:
    """Landmarks that span the strings: each time the one worst approximated by those before
    it (pivoted Cholesky factorisation of the kernel matrix), until all are well approximated."""
    blank = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0)
    rest = np.zeros(len(strings))
    for at, codes in by_length(strings):
        cells, weight = feature_cells(codes)
        rest[at] = [(np.bincount(np.unique(own, return_inverse=True)[1], weight) ** 2).sum() / _scale(codes.shape[1]) ** 2 for own in cells]
    parts, out = np.zeros((most, len(strings))), []
    for turn in range(min(most, len(strings))):
        i = int(rest.argmax())
        if rest[i] < least:
            break
        blank.table = dense([strings[i]])[0]
        column = blank.values(strings) - parts[:turn].T @ parts[:turn, i]
        parts[turn] = column / np.sqrt(rest[i])
        rest = np.maximum(rest - parts[turn] ** 2, 0)
        rest[i] = 0
        out.append(strings[i])
    return out


def fit(positives: list[str], negatives: list[str], seed: int) -> Machine:
    """Landmarks, Nystrom features, a linear machine on them, folded into a table."""
    rng = np.random.default_rng(seed)
    others = [negatives[i] for i in rng.choice(len(negatives), min(LANDMARKS // 3, len(negatives)), False)]
    marks = dense(pivots(positives, LANDMARKS - LANDMARKS // 3) + others)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-5 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    strings = positives + negatives
    w, bias = _linear(_products(strings, marks) @ root, np.where(np.arange(len(strings)) < len(positives), 1.0, -1.0))
    return Machine(((root @ w) @ marks).astype(np.float32), bias)


def families(bags: list[list[str]], turns: int = 3) -> list[tuple[int, ...]]:
    """For each bag some least hashes of its units: near copies of a text mostly share them."""
    out = []
    for bag in bags:
        codes = np.fromiter((crc32(u.encode()) for u in bag), np.uint64, len(bag))
        out.append(tuple(int(mix(codes + np.uint64(t << 32)).min()) if len(codes) else 0 for t in range(turns)))
    return out


def spread(bags: list[list[str]], among: set[str], least: int) -> set[str]:
    """Units of ``among`` in bags of ``least`` families or more. A unit that is frequent only
    because one text was copied isn't."""
    own = families(bags)
    where: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for u in bag:
            if u in among:
                where.setdefault(u, []).append(i)
    return {u for u, at in where.items() if len(at) >= least and min(len(set(x)) for x in zip(*(own[i] for i in at), strict=True)) >= least}


def disturbed(strings: list[str], rng: np.random.Generator) -> list[str]:
    """The strings with a character put in, and with one put in and one left out."""
    out = []
    for u in strings:
        if 4 <= len(u) < REACH:
            i = int(rng.integers(1, len(u)))
            more = u[:i] + _LETTERS[int(rng.integers(26))] + u[i:]
            j = int(rng.integers(1, len(more)))
            out += [more, more[:j] + more[j + 1 :]]
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 3, rounds: int = ROUNDS) -> Machine:
    return train_bags([bag(t) for t in texts], labels, seed, rounds)


def train_bags(bags: list[list[str]], labels: np.ndarray, seed: int = 3, rounds: int = ROUNDS) -> Machine:
    rng = np.random.default_rng(seed)
    toxic = [b for b, y in zip(bags, labels, strict=True) if y == 1]
    clean = [b for b, y in zip(bags, labels, strict=True) if y == 0]
    blank = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, 1.0, 3.0 if toxic and not clean else -3.0)
    if not toxic or not clean:
        return blank
    seen, other = Counter(u for b in toxic for u in b), Counter(u for b in clean for u in b)
    lean = {u: np.log((n + 0.5) / len(toxic)) - np.log((other[u] + 0.5) / len(clean)) for u, n in seen.items()}
    chosen = spread(toxic, {u for u, n in lean.items() if n > 4}, max(4, len(toxic) // 200))
    positives = sorted(chosen) or sorted({max(b, key=lambda u: (lean[u], u)) for b in toxic if b})
    common = sorted(other)
    machine = blank
    negatives = [common[i] for i in rng.choice(len(common), min(NEGATIVES, len(common)), False)] if common else []
    if not positives or not negatives:
        return blank
    unexplained = [b for b in toxic if b and not chosen.intersection(b)]
    for turn in range(rounds):
        machine = fit(positives + disturbed(positives, rng), negatives + disturbed(negatives[:: max(1, 3 * len(negatives) // NEGATIVES)], rng), seed + turn)
        worth = machine.values(common)
        negatives = sorted(set(negatives) | {common[i] for i in np.argsort(-worth, kind="stable")[: NEGATIVES // 6]})
        tops = [max(zip(machine.values(b).tolist(), b, strict=True)) for b in unexplained]
        positives = sorted({*positives, *spread(toxic, {u for value, u in tops if value > 0 and not other[u]}, 3)})
    size = np.array([len(b) for b in bags])
    flat = machine.values([u for b in bags for u in b])
    best = np.full(len(bags), machine.bias)
    best[size > 0] = np.maximum.reduceat(flat, (np.cumsum(size) - size)[size > 0])
    return _calibrated(machine, best, labels)


def _calibrated(machine: Machine, best: np.ndarray, labels: np.ndarray) -> Machine:
    """Platt's sigmoid on the texts' highest values, both labels weighing alike."""
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * best + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * best).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * best * best).sum() + 1e-3, (h * best).sum()], [(h * best).sum(), h.sum()]])
        move = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    machine.slope, machine.offset = float(a), float(b)
    return machine


def text_values(machine: Machine, texts: list[str], name: str = "") -> np.ndarray:
    """Each text's highest unit value; a worker keeps the values of the units it has met, under the machine's name."""
    memo = learned("toxicity").setdefault(name or machine.name(), {})
    found = [units(t) for t in texts]
    new = set().union(*found).difference(memo)
    if len(memo) + len(new) > MEMO_UNITS:
        memo.clear()
        new = set().union(*found)
    order = list(new)
    memo.update(zip(order, machine.unit_values(order).tolist(), strict=True))
    return np.array([max(map(memo.__getitem__, f), default=machine.bias) for f in found])


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, name = sent.value
        memos = learned("toxicity")
        for key in set(memos) - {name}:
            del memos[key]
        for part, texts in text_batches(batches, operator="toxicity"):
            best = text_values(machine, [t.decode("utf-8", "replace") for t in texts], name)
            yield pa.RecordBatch.from_arrays([part.column("of_id"), pa.array(machine.probability(best).astype(np.float64))], names=["of_id", "score"])

    return run


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and score (0 to 1; higher: toxic is likelier).

    A null or empty text has the machine's bias for its value and so a low score. Repeated
    rows are scored each; a null id stays null; other columns are ignored whatever their
    names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((machine, machine.name()))
    source = docs.select(F.col(id_col).cast("long").alias("of_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_scores(sent), "of_id long, score double").withColumnRenamed("of_id", id_col)
