"""The learned models against their definitions: forward passes, likelihoods and gradients."""

from itertools import product

import numpy as np
import pytest

from veldt.llm import pii, quality, toxicity

RNG = np.random.default_rng(0)


def same_gradients(parts, loss, found, rng, step=1e-6):
    """Of a few places of each part, against the difference quotient."""
    for part, g in zip(parts, found, strict=True):
        flat, own = part.reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.choice(len(flat), min(8, len(flat)), False):
            was = flat[i]
            flat[i] = was + step
            above = loss()
            flat[i] = was - step
            below = loss()
            flat[i] = was
            assert own[i] == pytest.approx((above - below) / (2 * step), rel=1e-3, abs=1e-6)


def network(rng):
    q = quality
    return q.Network(*(rng.normal(0, 0.2, n) for n in ((257, q.EMBED), (q.TAPS * q.EMBED, q.FILTERS), q.FILTERS, (3 * q.FILTERS, q.HIDDEN), q.HIDDEN, q.HIDDEN, 1)))


def slow_score(net, text):
    """One text, place by place, filter by filter."""
    q = quality
    step, tops = q.CHUNK - q.TAPS + 1, []
    for begin in range(0, max(1, len(text) - q.TAPS + 1), step):
        part = [*text[begin : begin + q.CHUNK], *[256] * q.CHUNK][: q.CHUNK]
        best = np.full(q.FILTERS, -np.inf)
        for place in range(0, q.CHUNK - q.TAPS + 1, q.STRIDE):
            best = np.maximum(best, np.concatenate([net.embed[b] for b in part[place : place + q.TAPS]]) @ net.filters)
        tops.append(np.maximum(best + net.bias, 0))
    tops = np.array(tops)
    hidden = np.maximum(np.concatenate([tops.mean(0), tops.max(0), tops.min(0)]) @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias[0])))


def test_quality_scores_by_definition():
    net = network(np.random.default_rng(1))
    texts = [bytes(RNG.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 9, 10, 255, 256, 257, 503, 504, 3000)]
    assert quality.score(net, texts, piece=3) == pytest.approx([slow_score(net, t) for t in texts], rel=1e-9)


def test_quality_gradients():
    rng = np.random.default_rng(2)
    net = network(rng)
    cut = [quality.chunks(bytes(rng.integers(32, 127, n).astype(np.uint8))) for n in (5, 300, 900, 1800)]
    x, size, y = np.concatenate(cut), np.array([len(c) for c in cut]), np.array([0, 1, 1, 0])
    loss, found = quality.gradients(net, x, size, y, piece=4)
    assert loss == pytest.approx(-np.mean([np.log(p if k else 1 - p) for p, k in zip(quality.combine(net, quality.pooled(net, x), np.cumsum(size) - size)[2], y, strict=True)]))
    same_gradients(net.parts(), lambda: quality.gradients(net, x, size, y)[0], found, rng)


def tagger(rng):
    p = pii
    make = lambda *n: rng.normal(0, 0.5, n)
    return p.Tagger(make(p.SYMBOLS, p.EMBED), [make(p.EMBED, 4 * p.STATE) for _ in "ab"], [make(p.STATE, 4 * p.STATE) for _ in "ab"], [make(4 * p.STATE) for _ in "ab"], make(2 * p.STATE, p.TAGS), make(p.TAGS), make(p.TAGS, p.TAGS))


def slow_emissions(net, x):
    """One window, step by step, by the equations of the cell."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    sides = []
    for side in (0, 1):
        h = c = np.zeros(pii.STATE)
        out = []
        for code in x if side == 0 else x[::-1]:
            z = net.embed[code] @ net.taken[side] + net.gate[side] + h @ net.kept[side]
            i, f, o, g = z.reshape(4, pii.STATE)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        sides.append(out if side == 0 else out[::-1])
    return np.concatenate(sides, 1) @ net.emit + net.emit_bias


def paths(net, score):
    """The score of every path of tags that is allowed."""
    ok = pii.allowed()
    for path in product(range(pii.TAGS), repeat=len(score)):
        if all(ok[a, b] for a, b in zip(path, path[1:], strict=False)):
            yield path, sum(score[t, k] for t, k in enumerate(path)) + sum(net.move[a, b] for a, b in zip(path, path[1:], strict=False))


def test_tagger_decodes_the_best_path():
    rng = np.random.default_rng(3)
    net = tagger(rng)
    x = rng.integers(0, pii.SYMBOLS, (6, 4))
    score = pii.emissions(net, x)
    for i, (own, tags) in enumerate(zip(x, pii.decode(net, x), strict=True)):
        assert score[:, i] == pytest.approx(slow_emissions(net, own))
        assert tuple(tags) == max(paths(net, score[:, i]), key=lambda p: p[1])[0]


def test_tagger_gradients():
    rng = np.random.default_rng(4)
    net = tagger(rng)
    x = rng.integers(0, pii.SYMBOLS, (3, 4))
    tags = np.array([[0, 1, 2, 0], [3, 4, 4, 5], [0, 0, 7, 8]])

    def loss():
        total = 0.0
        for own, line in zip(x, tags, strict=True):
            every = dict(paths(net, slow_emissions(net, own)))
            top = max(every.values())
            total += top + np.log(sum(np.exp(v - top) for v in every.values())) - every[tuple(line.tolist())]
        return total / len(x)

    same_gradients(net.parts(), loss, pii.gradients(net, x, tags), rng)


def test_toxicity_values_by_definition():
    """A text's value is the highest of its units', a unit's the sum of the table over its triples."""
    rng = np.random.default_rng(6)
    machine = toxicity.Machine(rng.normal(size=toxicity.SYMBOLS**3).astype(np.float32), -0.25, 2.0, 0.5)

    def code(c):
        return toxicity._LETTERS.index(c) + 3 if c in toxicity._LETTERS else 1 if c.isdigit() else 2 if c.isalpha() else 0

    def value(unit):
        best = -np.inf
        for s in toxicity.stretches(unit):
            total, norm = 0.0, 0.0
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, len(s)):
                        weight = toxicity.DECAY ** (k - i + 1)
                        total += weight * machine.table[(code(s[i]) * toxicity.SYMBOLS + code(s[j])) * toxicity.SYMBOLS + code(s[k])]
                        norm += weight * weight
            best = max(best, machine.bias + (total / np.sqrt(norm) if norm else 0.0))
        return best

    texts = ["Nice day, you s-t-u-p-i-d i d i o t!", "ab", "", "x" * 40 + " 12 naïve Ωmega" + "qwertyuiopasdfghjklzxcvbnm", "a1b2 c3"]
    found = toxicity.text_values(machine, texts)
    for text, best in zip(texts, found, strict=True):
        assert best == pytest.approx(max(map(value, toxicity.units(text)), default=machine.bias), rel=1e-4, abs=1e-4)
    assert machine.probability(found) == pytest.approx(1 / (1 + np.exp(-(2 * found + 0.5))))
