"""Personal data in whole texts: exact base patterns, and a character model that adds to them.

The base finds e-mail addresses, IP addresses, card and telephone numbers by pattern and
check. A bidirectional LSTM over characters with a CRF on top, trained here in numpy from
labelled spans, reads overlapping windows; each character's tag is taken from the window
in which it stands furthest from a cut, and spans are read off the text's whole tag
sequence, so one that crosses a cut is found once. Spans of the model that don't touch a
base span and hold a digit or an @ are added; base spans always stay.

All four kinds hold a digit or an @, so a window with neither, read or not, adds nothing:
such windows are passed over. Every other window is read, wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, MARGIN = 128, 32
EMBED, STATE = 8, 16
#: Windows with base spans, and as many without, that are used for training at most.
TRAIN_WINDOWS = 1200
#: Documents from which these are taken, about so many.
TRAIN_DOCUMENTS = 20_000
ROUNDS = 220
BATCH = 32
#: Tags: 0 outside; of kind k, 2k + 1 for its first character and 2k + 2 for the others.
TAGS = 2 * len(KINDS) + 1

# ------------------------------------------------------------------- base ---

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No retries from inside a run of digits: a match that begins there would fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left as far as the local part goes: linear in long runs too."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _EMAIL_TAIL.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1) if begin == at else free
            at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; positions in code points, end exclusive."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# ------------------------------------------------------------------ model ---

_SHOWN = "\n !\"#$%&'()*+,-./0123456789:;<=>?@abcdefghijklmnopqrstuvwxyz[\\]^_{|}~"
_CODES = np.full(128, 1, np.int64)
for _i, _c in enumerate(_SHOWN):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i + 3
SYMBOLS = len(_SHOWN) + 3  # 0 padding, 1 other ASCII, 2 everything else


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 2)


@dataclass
class Tagger:
    embed: np.ndarray  # SYMBOLS x EMBED
    taken: list[np.ndarray]  # per direction: EMBED x 4 STATE
    kept: list[np.ndarray]  # per direction: STATE x 4 STATE
    gate: list[np.ndarray]
    emit: np.ndarray  # 2 STATE x TAGS
    emit_bias: np.ndarray
    move: np.ndarray  # TAGS x TAGS

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.taken, *self.kept, *self.gate, self.emit, self.emit_bias, self.move]


def allowed() -> np.ndarray:
    """A kind's inner tag follows its first or inner tag only."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 * k + 2] = False
        ok[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(net: Tagger, x: np.ndarray, side: int, keep: bool) -> tuple[np.ndarray, list]:
    """Outputs in reading order of the direction; x: time x batch."""
    table = net.embed @ net.taken[side] + net.gate[side]
    h = c = np.zeros((x.shape[1], STATE), table.dtype)
    out, trail = np.empty((len(x), x.shape[1], STATE), table.dtype), []
    for t in range(len(x)):
        z = table[x[t]] + h @ net.kept[side]
        s = _sigmoid(z[:, : 3 * STATE])
        g = np.tanh(z[:, 3 * STATE :])
        i, f, o = s[:, :STATE], s[:, STATE : 2 * STATE], s[:, 2 * STATE :]
        before_c, before_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            trail.append((before_h, before_c, i, f, o, g, tc))
    return out, trail


def emissions(net: Tagger, x: np.ndarray) -> np.ndarray:
    """x: windows x time; time x windows x TAGS."""
    turned = np.ascontiguousarray(x.T)
    ahead, _ = _lstm(net, turned, 0, False)
    back, _ = _lstm(net, turned[::-1], 1, False)
    return np.concatenate([ahead, back[::-1]], 2) @ net.emit + net.emit_bias


def decode(net: Tagger, x: np.ndarray) -> np.ndarray:
    """Viterbi's best tags, windows x time."""
    score = emissions(net, x)
    move = np.where(allowed(), net.move, -1e4).astype(score.dtype)
    best, back = score[0].copy(), np.empty((len(score), x.shape[0], TAGS), np.int8)
    for t in range(1, len(score)):
        each = best[:, :, None] + move
        back[t] = each.argmax(1)
        best = each.max(1) + score[t]
    tags = np.empty((x.shape[0], len(score)), np.int8)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(x.shape[0])
    for t in range(len(score) - 1, 0, -1):
        tags[:, t - 1] = back[t][rows, tags[:, t]]
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _crf(net: Tagger, score: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood to the scores and the moves."""
    time, batch, _ = score.shape
    move = np.where(allowed(), net.move, -1e4)
    a = np.empty(score.shape)
    b = np.zeros(score.shape)
    a[0] = score[0]
    for t in range(1, time):
        a[t] = _log_sum(a[t - 1][:, :, None] + move, 1) + score[t]
    for t in range(time - 2, -1, -1):
        b[t] = _log_sum(move + (score[t + 1] + b[t + 1])[:, None, :], 2)
    z = _log_sum(a[-1], 1)
    d_score = np.exp(a + b - z[None, :, None])
    pair = np.exp(a[:-1][:, :, :, None] + move + (score[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])
    d_move = pair.sum((0, 1))
    rows = np.arange(batch)
    for t in range(time):
        d_score[t][rows, tags[:, t]] -= 1
    np.subtract.at(d_move, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1)
    return (d_score / batch).astype(score.dtype), (d_move / batch).astype(score.dtype)


def gradients(net: Tagger, windows: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-likelihood, in the order of parts(), back through time."""
    x = np.ascontiguousarray(windows.T)
    out, trails = zip(*(_lstm(net, x if s == 0 else x[::-1], s, True) for s in (0, 1)), strict=True)
    both = np.concatenate([out[0], out[1][::-1]], 2)
    d_score, d_move = _crf(net, both @ net.emit + net.emit_bias, tags)
    d_emit, d_bias = np.einsum("tbh,tbk->hk", both, d_score), d_score.sum((0, 1))
    d_both = d_score @ net.emit.T
    d_embed, d_taken, d_kept, d_gate = np.zeros_like(net.embed), [], [], []
    for s in (0, 1):
        d_out = d_both[:, :, :STATE] if s == 0 else d_both[::-1, :, STATE:]
        order = x if s == 0 else x[::-1]
        dz = np.empty((len(x), x.shape[1], 4 * STATE), net.embed.dtype)
        dh = dc = np.zeros((x.shape[1], STATE), net.embed.dtype)
        g_kept = np.zeros_like(net.kept[s])
        for t in range(len(x) - 1, -1, -1):
            h0, c0, i, f, o, g, tc = trails[s][t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            g_kept += h0.T @ dz[t]
            dh = dz[t] @ net.kept[s].T
            dc = dc * f
        cell = np.stack([np.bincount(order.reshape(-1), dz[:, :, k].reshape(-1), SYMBOLS) for k in range(4 * STATE)], 1).astype(net.embed.dtype)
        d_taken.append(net.embed.T @ cell)
        d_embed += cell @ net.taken[s].T
        d_kept.append(g_kept)
        d_gate.append(cell.sum(0))
    return [d_embed, *d_taken, *d_kept, *d_gate, d_emit, d_bias, d_move]


def train(windows: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, seed: int = 9) -> Tagger:
    """Adam on the CRF's likelihood, of batches most of which hold spans."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    make = lambda *n: rng.normal(0, 1 / np.sqrt(n[0]), n).astype(f32)
    gate = np.zeros(4 * STATE, f32)
    gate[STATE : 2 * STATE] = 1
    net = Tagger(rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(f32), [make(EMBED, 4 * STATE) for _ in "ab"], [make(STATE, 4 * STATE) for _ in "ab"], [gate.copy() for _ in "ab"], make(2 * STATE, TAGS), np.zeros(TAGS, f32), np.zeros((TAGS, TAGS), f32))
    some = (tags > 0).any(1)
    with_, without = np.flatnonzero(some), np.flatnonzero(~some)
    if not len(with_):
        net.emit[:] = 0
        net.emit_bias[0] = 10
        return net
    if not len(without):
        without = with_
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for turn in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(with_, BATCH * 3 // 4), rng.choice(without, BATCH // 4)])
        rate = 0.02 * min(1, turn / 20) * (1 - turn / (rounds + 1)) + 2e-4
        for i, (p, g) in enumerate(zip(net.parts(), gradients(net, windows[pick], tags[pick]), strict=True)):
            g = np.clip(g, -1, 1)
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p -= (rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)).astype(f32)
    return net


# ---------------------------------------------------------------- windows ---


def tags_of(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Tags of a text from its spans; of spans that overlap the earlier ones count."""
    out, free = np.zeros(n, np.int8), 0
    for a, b, k in spans:
        if a >= free:
            out[a], out[a + 1 : b] = 2 * k + 1, 2 * k + 2
            free = b
    return out


def window_starts(n: int) -> np.ndarray:
    """Windows overlap by two margins and cover all of the text."""
    step = WINDOW - 2 * MARGIN
    return np.arange(0, max(1, -(-(n - 2 * MARGIN) // step))) * step


def _window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, codes.dtype)
    part = codes[start : start + WINDOW]
    out[: len(part)] = part
    return out


def _tells(codes: np.ndarray) -> np.ndarray:
    """Digits and @."""
    zero, at = _CODES[ord("0")], _CODES[ord("@")]
    return ((codes >= zero) & (codes <= zero + 9)) | (codes == at)


def find(net: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text."""
    todo: list[tuple[int, int]] = []
    rows, codes, bases = [], [], []
    for i, text in enumerate(texts):
        bases.append(base_spans(text))
        own = symbols(text)
        codes.append(own)
        tell = np.flatnonzero(_tells(own))
        if not len(tell):
            continue
        starts = window_starts(len(own))
        near = np.searchsorted(tell, starts + WINDOW) > np.searchsorted(tell, starts)
        for start in starts[near].tolist():
            todo.append((i, start))
            rows.append(_window(own, start))
    tags: dict[int, np.ndarray] = {}
    for begin in range(0, len(rows), 512):
        found = decode(net, np.stack(rows[begin : begin + 512]))
        for (i, start), own in zip(todo[begin : begin + 512], found, strict=True):
            n = len(codes[i])
            line = tags.setdefault(i, np.zeros(n, np.int8))
            a = start + (MARGIN if start else 0)
            b = n if start + WINDOW >= n else start + WINDOW - MARGIN
            line[a:b] = own[a - start : b - start]
    out = []
    for i, base in enumerate(bases):
        added = []
        if i in tags and (tags[i] > 0).any():
            covered = np.zeros(len(codes[i]) + 1, bool)
            for a, b, _ in base:
                covered[a:b] = True
            tell = _tells(codes[i])
            for a, b, k in spans_of(tags[i]):
                if not covered[a:b].any() and tell[a:b].any():
                    added.append((a, b, k))
        out.append((base, added))
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind; a first tag begins a new one."""
    kind = (tags.astype(np.int64) + 1) // 2
    edge = np.ones(len(tags), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(tags))
    return [(int(a), int(b), int(kind[a]) - 1) for a, b in zip(starts, ends, strict=True) if kind[a]]


# ------------------------------------------------------------------ frame ---

_SPANS = "array<struct<start:long,finish:long,kind:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("finish", pa.int64()), ("kind", pa.string())]))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around digits and @, with their tags by the base patterns; texts without either have none."""
    for part, texts in text_batches(batches):
        ids, at, code, tag, some = [], [], [], [], []
        for doc, raw in zip(part.column("of_id").to_pylist(), texts, strict=True):
            text = raw.decode("utf-8", "replace")
            own = symbols(text)
            tell = np.flatnonzero(_tells(own))
            if not len(tell):
                continue
            line = tags_of(base_spans(text), len(own))
            starts = window_starts(len(own))
            for start in starts[np.searchsorted(tell, starts + WINDOW) > np.searchsorted(tell, starts)].tolist():
                mark = _window(line, start)
                if mark[0] and mark[0] % 2 == 0:
                    continue  # begins inside a span
                ids.append(doc)
                at.append(start)
                code.append(_window(own, start).astype(np.uint8).tobytes())
                tag.append(mark.tobytes())
                some.append(bool(mark.any()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(code, pa.binary()), pa.array(tag, pa.binary()), pa.array(some, pa.bool_())], names=["of_id", "at", "code", "tag", "some"])


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: int = TRAIN_WINDOWS, documents: int = TRAIN_DOCUMENTS) -> Tagger:
    """A tagger trained on at most ``windows`` windows with spans and as many without, by the
    hash of their place, from about ``documents`` documents (all, if there are fewer), by the
    hash of their id."""
    small_batches(docs.sparkSession)
    share = min(1.0, documents / max(1, docs.count()))
    by_id = F.pmod(F.xxhash64("of_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    source = docs.select(F.col(id_col).cast("long").alias("of_id"), F.col(text_col).alias("text")).where(by_id)
    found = source.mapInArrow(_train_rows, "of_id long, at long, code binary, tag binary, some boolean").withColumn("by", F.xxhash64("of_id", "at"))
    rows = [r for want in (True, False) for r in found.where(F.col("some") == want).orderBy("by", "of_id", "at").limit(windows).collect()]
    if not rows:
        return train(np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int8))
    code = np.frombuffer(b"".join(bytes(r.code) for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return train(code, np.frombuffer(b"".join(bytes(r.tag) for r in rows), np.int8).reshape(-1, WINDOW).copy())


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part, texts in text_batches(batches):
            found = find(net, [t.decode("utf-8", "replace") for t in texts])
            cols = [pa.array([[{"start": a, "finish": b, "kind": KINDS[k]} for a, b, k in own] for own in side], _SPAN_TYPE) for side in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("of_id"), *cols], names=["of_id", "base", "added"])

    return run


def personal_data(docs: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, base and added (arrays of start, finish, kind; code points,
    finish exclusive; by start, then kind).

    Null and empty texts have none. Repeated rows are read each; a null id stays null; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(F.col(id_col).cast("long").alias("of_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_find(sent), f"of_id long, base {_SPANS}, added {_SPANS}").withColumnRenamed("of_id", id_col)


def _mask(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part, texts in text_batches(batches):
            plain = [t.decode("utf-8", "replace") for t in texts]
            out = []
            for text, (base, added) in zip(plain, find(net, plain), strict=True):
                parts, free = [], 0
                for a, b, k in sorted(base + added):
                    if a >= free:
                        parts += [text[free:a], f"[{KINDS[k].upper()}]"]
                    free = max(free, b)
                out.append("".join(parts) + text[free:])
            was = part.column("text")
            new = pa.array([None if not v.is_valid else x for x, v in zip(out, was, strict=True)], pa.string())
            sizes = pa.array([None if not v.is_valid else len(x) for x, v in zip(out, was, strict=True)], pa.int64())
            cols = {"text": new} | ({"n_chars": sizes} if "n_chars" in part.schema.names else {})
            yield pa.RecordBatch.from_arrays([cols.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return run


def masked(docs: DataFrame, net: Tagger) -> DataFrame:
    """docs with each span of its text column replaced by its kind in brackets, and n_chars, if there, brought up to date."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_mask(sent), docs.schema)
