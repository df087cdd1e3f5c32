"""Packing token sequences into windows of fixed capacity.

Texts are tokenised, every document's full windows are taken as they are, and what is
left over is cut into pieces and packed by Karmarkar-Karp multiway differencing: each
piece starts as a partial partition of its own, and the two partial partitions with the
largest imbalance are merged, largest part against smallest, until one is left. If a
part exceeds the capacity, the number of windows rises by one and the block is packed
again. Blocks hold a bounded number of tokens, so memory doesn't depend on the input,
and a window never leaves its task: nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SOLID, Words, byte_class, byte_hashes, learned, small_batches, text_batches

CAPACITY = 2048
#: Left-over tokens are halved into pieces down to about this many: with pieces of every
#: size, the small ones even out what the large ones leave.
LEAST_PIECE = 16
#: Windows packed at a time.
BLOCK_WINDOWS = 64
#: Tokens left free in a full block for each of its windows, for what differencing leaves uneven.
SLACK = 8
END_ID = 1
#: Units whose ids a worker remembers; beyond it forgets all and starts anew.
MEMO_UNITS = 500_000

_SUFFIX_SECONDS = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])  # À-Ö, Ø-ö, ø-ÿ behind 0xC3
_ASCII_LETTER = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class Units:
    """The units of some texts: the tokenizer's pre-tokens never span ASCII white space, nor a
    run of plain letters and a following ASCII sign, so a text's ids are those of its units one
    after the other. A unit is what white space parts, or one of the two parts of that, behind
    the plain letters it begins with, if an ASCII sign follows.

    start, end: byte positions in ``words.data``; hash, check: of the bytes, 64 and 32 bits;
    per_text: how many.
    """

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts, SOLID, lower=False)
        data = words.data
        letter = _ASCII_LETTER[data]
        pair = (data[:-1] == 0xC3) & _SUFFIX_SECONDS[data[1:]]
        letter[:-1] |= pair
        letter[1:] |= pair
        other = np.append(np.flatnonzero(~letter), len(data))
        stop = other[np.searchsorted(other, words.start)]
        cut = (stop > words.start) & (stop < words.end)
        cut[cut] = data[stop[cut]] < 128
        count = 1 + cut
        at = np.cumsum(count) - 1
        self.start, self.end = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        self.end[at] = words.end
        self.start[at] = np.where(cut, stop, words.start)
        self.end[at[cut] - 1] = stop[cut]
        self.start[at[cut] - 1] = words.start[cut]
        self.per_text = np.diff(np.concatenate([[0], at + 1])[np.append(words.first, len(words))])
        self.hash, self.check = (byte_hashes(data, self.start, self.end, kind) for kind in (0, 1))
        self.check = self.check.astype(np.uint32)

    def text(self, i: int) -> bytes:
        return self.words.data[self.start[i] : self.end[i]].tobytes()


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(len(array), n - len(array)), array.dtype)])


class _Memo:
    """Ids of units by their hashes, in arrays alone: some 40 bytes a unit."""

    def __init__(self):
        self.n = self.used = 0
        self.slots = np.full(1 << 16, -1, np.int32)  # open addressing, at most half full
        self.hash, self.check = np.zeros(1024, np.uint64), np.zeros(1024, np.uint32)
        self.start, self.size, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def places(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of the units, -1 of those that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        todo, mask = np.arange(len(hashes)), len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            number = self.slots[slot]
            taken = number >= 0
            same = taken & (self.hash[number] == hashes[todo]) & (self.check[number] == check[todo])
            out[todo[same]] = number[same]
            on = taken & ~same
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def _enter(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.hash[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            on = self.slots[slot] != numbers
            numbers, slot = numbers[on], (slot[on] + 1) & mask

    def add(self, hashes: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Units that differ and aren't there yet; ids: of all of them in order."""
        n, more = self.n, self.n + len(hashes)
        self.hash, self.check, self.start, self.size = (_grown(x, more) for x in (self.hash, self.check, self.start, self.size))
        self.ids = _grown(self.ids, self.used + len(ids))
        self.hash[n:more], self.check[n:more], self.size[n:more] = hashes, check, size
        self.start[n:more] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n = more
        if 2 * more > len(self.slots):
            self.slots = np.full(1 << (2 * more).bit_length(), -1, np.int32)
            n = 0
        self._enter(np.arange(n, more))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at these places, one after the other, and how many each has."""
        size = self.size[at].astype(np.int64)
        end = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], size


class UnitEncoder:
    """Ids by a tokenizers file whose pre-tokens don't span white space, unit by unit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None)
        self.ends = self.bare = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
            # The same model without the steps ahead of it, which leave a lower-case ASCII word as it is.
            bare = Tokenizer(model)
            bare.pre_tokenizer = CharDelimiterSplit(" ")
            some = [w for w in (piece.removesuffix(suffix) for piece in sorted(vocabulary)[::50]) if w.isascii() and w.isalpha() and w == w.lower()]
            ids = bare.encode(" ".join(some)).ids
            if some and all(ids == self.tokenizer.encode(" ".join(x), add_special_tokens=False).ids for x in (some, [w.upper() for w in some])):
                self.bare = bare
        self.memo = _Memo()

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the units; in that order their ids, one after the other, and how many each has."""
        orders, sizes, every = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        rest = range(len(units))
        for plain, tokenizer in ((lambda u: u.isalpha() and u.islower(), self.bare), (_PLAIN.fullmatch, self.tokenizer if self.ends is not None else None)):
            if tokenizer is None:
                continue
            at, other = [], []
            for i in rest:
                (at if plain(units[i]) else other).append(i)
            rest = other
            # Of each of these the last id alone ends a word: many are encoded at a time.
            lines = [b" ".join([units[i] for i in at[j : j + 400]]).decode() for j in range(0, len(at), 400)]
            ids = np.array(list(chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False))), np.uint32)
            orders.append(np.array(at, np.int64))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
            every.append(ids)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)]
        orders.append(np.array(rest, np.int64))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        every.append(np.array(list(chain.from_iterable(found)), np.uint32))
        return np.concatenate(orders), np.concatenate(sizes), np.concatenate(every)

    def places(self, units: Units) -> np.ndarray:
        """Each unit's number in the memory, once those that are new are in it too."""
        at = self.memo.places(units.hash, units.check)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            order = lacking[np.lexsort((units.check[lacking], units.hash[lacking]))]
            new = order[np.concatenate([[True], (units.hash[order[1:]] != units.hash[order[:-1]]) | (units.check[order[1:]] != units.check[order[:-1]])])]
            if self.memo.n and self.memo.n + len(new) > MEMO_UNITS:
                self.memo = _Memo()
                return self.places(units)
            order, size, ids = self._encoded([units.text(i) for i in new.tolist()])
            new = new[order]
            self.memo.add(units.hash[new], units.check[new], size, ids)
            at[lacking] = self.memo.places(units.hash[lacking], units.check[lacking])
        return at

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and how many each has."""
        # A-Z small, where that makes no difference and there can't be a special token.
        units = Units([x if self.bare is None or b"<|" in x else x.lower() for x in texts])
        found, size = self.memo.gather(self.places(units))
        per_doc = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(units.per_text)])]) + 1
        ids = np.empty(int(per_doc.sum()), np.uint32)
        stop = np.cumsum(per_doc) - 1
        body = np.ones(len(ids), bool)
        body[stop] = False
        ids[stop] = end_id
        ids[body] = found
        return ids, per_doc


def encoder(path: str) -> UnitEncoder:
    """One for each worker process, with what it has learned."""
    known = learned("packing")
    if path not in known:
        known[path] = UnitEncoder(path)
    return known[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp k-way partition of the items: lists of their positions, near-equal in sum."""
    if k == 1 or len(sizes) <= 1:
        return [list(range(len(sizes))), *[[] for _ in range(k - 1)]]
    # A state holds the parts that aren't empty, by falling sum above the least part; the
    # other parts are all empty and at the least sum.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a_sum, a_items = heapq.heappop(heap)
        _, _, b_sum, b_items = heapq.heappop(heap)
        if len(a_sum) + len(b_sum) <= k:
            sums, items = a_sum + b_sum, a_items + b_items
        else:
            a, b = np.zeros(k, np.int64), np.zeros(k, np.int64)
            a[: len(a_sum)] = a_sum
            b[: len(b_sum)] = b_sum
            total = a + b[::-1]
            pad_a, pad_b = a_items + [[]] * (k - len(a_items)), b_items + [[]] * (k - len(b_items))
            sums, items = total.tolist(), [x + y for x, y in zip(pad_a, reversed(pad_b), strict=True)]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]] if len(sums) == k else 0
        sums, items = [sums[i] - low for i in order], [items[i] for i in order]
        heapq.heappush(heap, (-sums[0], tick, sums, items))
        tick += 1
    items = heap[0][3]
    return items + [[] for _ in range(k - len(items))]


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items, none above capacity, as few as differencing finds from the least number on."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


_SCHEMA = "of_doc long, start long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def halves(start: int, end: int, least: int) -> list[tuple[int, int]]:
    """start..end cut into a half, a quarter and so on, the last two at least ``least`` long."""
    out = []
    while end - start >= 2 * least:
        middle = (start + end + 1) // 2
        out.append((start, middle))
        start = middle
    return [*out, (start, end)]


def _pack(tokenizer: str, end_id: int, capacity: int, least: int, block_windows: int):
    block = block_windows * (capacity - min(SLACK, capacity // 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        pool: list[tuple] = []  # doc, start, ids, doc_tokens
        pooled = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["of_doc", "start", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])

        def settle(pieces: list[tuple]) -> list[tuple]:
            nonlocal sequence
            out = []
            sizes = [len(p[2]) for p in pieces]
            for window in balanced_windows(sizes, capacity):
                at, total = 0, sum(sizes[i] for i in window)
                for i in window:
                    doc, start, ids, tokens = pieces[i]
                    out.append((doc, start, ids.tobytes(), tokens, sequence, at, total))
                    at += sizes[i]
                sequence += 1
            return out

        for part, texts in text_batches(batches, operator="packing"):
            ids, sizes = encode.encode(texts, end_id)
            rows, begin = [], 0
            for doc, n in zip(part.column("of_doc").to_pylist(), sizes.tolist(), strict=True):
                own = ids[begin : begin + n]
                begin += n
                full = n // capacity * capacity
                for at in range(0, full, capacity):
                    rows.append((doc, at, own[at : at + capacity].tobytes(), n, sequence, 0, capacity))
                    sequence += 1
                for a, b in halves(full, n, least) if n > full else ():
                    while pooled + b - a >= block:
                        cut = a + block - pooled
                        pool.append((doc, a, own[a:cut].copy(), n))
                        rows += settle(pool)
                        pool, pooled, a = [], 0, cut
                    if b > a:
                        pool.append((doc, a, own[a:b].copy(), n))
                        pooled += b - a
            if rows:
                yield batch(rows)
        if pool:
            yield batch(settle(pool))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, least_piece: int = LEAST_PIECE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a piece: the document's id, start (ids of it before), ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset there and sequence_tokens.

    tokenizer: path of a tokenizers file, the same on every executor, whose pre-tokens don't
    span white space. A null text counts as empty; an empty text has end_id alone. Every id
    lies in exactly one piece; a sequence's pieces follow each other without gaps and don't
    exceed capacity. Repeated rows are packed each. A null id is kept as null. Other
    columns of docs are ignored whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("of_doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(_pack(tokenizer, end_id, capacity, least_piece, block_windows), _SCHEMA).withColumnRenamed("of_doc", id_col)
