"""The text operators against brute force on small fixtures with the awkward cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from veldt.llm import decontamination, jaccard_join, packing, substring_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=1):
    """Random words, shared passages, copies, near copies, empty, null and short texts, one long text."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared, texts = [some(30) for _ in range(3)], []
    for i in range(60):
        words = some(rng.randrange(5, 80))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = shared[i % 3]
        texts.append(" ".join(words))
    near = some(120)
    for i in range(25):
        own = list(near)
        own[rng.randrange(120)] = f"other{i}"
        texts.append(" ".join(own))
    texts += [texts[0]] * 20 + ["", None, "One two", "one, TWO!", "...", "é́ naïve\tÀ b\x0bc", " ".join(some(6000)), "x " * 50, "x " * 50]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def clashing(spark, data, schema=DOCS):
    """With columns named like those the operators make on their way."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, schema).repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("id", "of_id", "of_doc", "key", "words", "start", "intervals", "n_words", "comp", "label")})


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_substring_dedup(spark, block):
    data = corpus()
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(clashing(spark, data), block_windows=block).collect()}
    seen, want = set(), {}
    for doc, text in sorted(data):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert got == want and sum(w[1] for w in want.values()) > 500


def test_decontamination(spark):
    data = corpus(2)
    rng = random.Random(5)
    long = [t.split() for _, t in data if t and len(t.split()) > 40]
    items = [(i, " ".join(w[(a := rng.randrange(20)) : a + rng.randrange(8, 30)])) for i, w in enumerate(long[:12])]
    items += [(100, "One two"), (101, ""), (102, None), (103, "one two"), (104, "w1"), (105, "x x x x x x x x x x x")]
    found = decontamination.contamination(clashing(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    got = {r[0]: (r[1], r[2], r["items"]) for r in found.collect()}
    windows = defaultdict(set)
    for item, text in items:
        w = lowered(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    want = {}
    for doc, text in data:
        w = lowered(text)
        hit, met = [0] * len(w), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    met |= own
                    hit[i : i + k] = [1] * k
        want[doc] = (len(w), sum(hit), sorted(map(str, met)))
    assert got == want and any(v[1] for v in want.values())


@pytest.mark.parametrize("sizes", [{}, {"split": 6, "sketch_block": 8, "set_block": 8}])
def test_jaccard_join(spark, sizes):
    data = corpus(3)
    got = {r[0]: (r["n_links"], r["component_id"], r["kept"], r["class_id"]) for r in jaccard_join.near_duplicates(clashing(spark, data), **sizes).collect()}
    sets = {}
    for doc, text in data:
        w = lowered(text)
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    linked = {a: {b for b in sets if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    want = {}
    for a in sets:
        reach, todo = {a}, [a]
        while todo:
            new = linked[todo.pop()] - reach
            reach |= new
            todo += new
        equal = min([b for b in sets if sets[b] == sets[a]]) if sets[a] else a
        want[a] = (len(linked[a]), min(reach), min(reach) == a, equal)
    assert got == want


def test_jaccard_join_of_the_least_sets(spark):
    """Four shingles inside five have a similarity of 0.8 as well."""
    words = "a b c d e f g h".split()
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(["p", "q", *words[2:]]), "a b c d e f g"]
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard_join.near_duplicates(clashing(spark, list(enumerate(texts)))).collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (0, 3, True)}


def test_jaccard_join_recalls_short_pairs(spark):
    """Pairs of few shingles at a similarity of 0.8 exactly, by words added at either end."""
    data, pairs = [], 0
    for common, before, after in ((4, 0, 1), (8, 0, 2), (8, 2, 0), (8, 1, 1), (12, 0, 3), (12, 1, 2), (40, 5, 5)):
        for _ in range(400):
            own = [f"p{pairs}w{i}" for i in range(common + 4 + before + after)]
            left, right = (own[before:], own[: len(own) - after]) if before and after else (own[before : len(own) - after], own)
            data += [(2 * pairs, " ".join(left)), (2 * pairs + 1, " ".join(right))]
            pairs += 1
    rows = jaccard_join.near_duplicates(clashing(spark, data)).collect()
    assert len(rows) == 2 * pairs and [r.doc_id for r in rows if r.n_links != 1 or r.component_id != r.doc_id // 2 * 2] == []


def test_jaccard_join_runs_reach_the_recall_at_every_depth():
    """Chance of a pair at the threshold to meet after all the splits that a bucket can go through."""
    met = np.prod([1 - np.exp(-n) for n in jaccard_join.SHARED])
    assert len(jaccard_join.SHARED) == jaccard_join.LEVELS
    for recall in (0.99, 0.9999):
        assert 1 - (1 - met) ** jaccard_join.runs_for(recall) >= recall


def test_sketches_of_either_kind_pass_similar_sets():
    """Sets on both sides of SHORT, within a group and across its middle."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for size in (5, 40, 230, 255, 256, 300, 318, 319, 320, 321, 600):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        sets = [base, base[: -(-size * 4 // 5)], rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)]
        sizes = np.array([len(x) for x in sets])
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(3), sizes)
        marks = {"sketch": jaccard_join._marks(jaccard_join.sketches, sizes >= jaccard_join.SHORT, hashes, owner), "parity": jaccard_join._marks(jaccard_join.parities, jaccard_join.has_parity(sizes, 4, 0.8), hashes, owner)}
        for side in ([0, 0, 0], [0, 1, 1]):
            rows = pa.table({"key": [1, 1, 1], "pair": [0, 0, 0], "side": side, "id": [10, 11, 12], "size": sizes, **marks})
            edges = [tuple(e.values()) for part in jaccard_join._sketch_edges(0.8)(iter([rows])) for e in part.to_pylist()]
            assert edges == [(10, 11)], (size, side)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    data = corpus(4)
    pieces = packing.pack(clashing(spark, data), path, capacity=64, block_windows=8).collect()
    tokenizer = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in data:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            at += len(r.ids) // 4
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at <= 64 and all(r.sequence_tokens == at for r in own)
    filled = sum(len(r.ids) // 4 for r in pieces)
    assert filled / (64 * len(by_sequence)) > 0.8


def test_differencing_balances():
    rng = random.Random(7)
    for _ in range(20):
        sizes = [rng.randrange(1, 200) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 9)
        parts = packing.differencing(sizes, k)
        assert sorted(i for part in parts for i in part) == list(range(len(sizes))) and len(parts) == k

    windows = packing.balanced_windows([5, 5, 5], 8)
    assert len(windows) == 3 and all(len(w) == 1 for w in windows)


def test_units_make_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["", "  ", "it's we'll 'tis abc'stop", "é abcéx á,b ß ﬁ ½ ² x²y a1b2", "<|endoftext|> abc<|endoftext|>d", "a.b.,c!d abc...,,,", "x̸=y", "a\x00b \x85 c\x1cd", "😀😀 a😀b", "a b"]
    encode, plain = packing.UnitEncoder(path), Tokenizer.from_file(path)
    ids, sizes = encode.encode([t.encode() for t in odd], 1)
    assert ids.tolist() == [i for t in odd for i in [*plain.encode(t, add_special_tokens=False).ids, 1]] and sizes.sum() == len(ids)


@pytest.mark.parametrize("run", [lambda d: substring_dedup.remove_repeats(d), lambda d: jaccard_join.near_duplicates(d), lambda d: decontamination.contamination(d, d.sparkSession.createDataFrame([], "item_id long, text string"))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0
    assert run(spark.createDataFrame([(1, None), (None, "a b c")], DOCS)).count() == 1
