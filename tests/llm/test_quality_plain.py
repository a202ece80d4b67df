"""The quality classifier against plain Python: its tokens, the mean of their vectors, and an epoch of gradient steps."""

from collections import Counter

import numpy as np

from tallyvox.llm import common, quality

M = (1 << 64) - 1
TEXTS = [b"BUY NOW now NOW BUY BUY", b"a calm river runs by", b"", b"one", b"  two\t words\n", "né é ñandú né".encode(), b"x" * 90, b"go go go go stop", b"A a A a", b"\x00 nul \x00"]


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_tokens(raw):
    """Buckets of words, pairs, marks of repeats, and runs of 3 and 5 characters, in any order."""
    gamma, base = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    value = [mix((i * gamma) & M) | 1 for i in range(1, 257)]
    top = lambda h: h >> (64 - quality.BITS)
    words, word = [], []
    for b in [*raw, 32]:
        if b in (0x20, *range(9, 14)):
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(b)
    hashes = [mix((sum(value[b] * pow(base, k, 1 << 64) for k, b in enumerate(w)) + len(w) * gamma) & M) for w in words]
    out = [top(mix(h)) for h in hashes]
    out += [top(mix((b * 3 + a) & M)) for a, b in zip(hashes, hashes[1:])]
    out += [lag * 8 + twice for lag in (1, 2, 3) for a, b in zip(hashes, hashes[lag:]) if a == b for twice in range(1, 5)]
    t = [int(quality._BYTES[32 if b in (0x20, *range(9, 14)) else b]) for b in b"\n" + raw + b"\n"]
    space = [b in (0x20, *range(9, 14)) for b in b"\n" + raw + b"\n"]
    c1, c2, c3, c4, shift = (int(x) for x in (quality._C1, quality._C2, quality._C3, quality._C4, quality._SHIFT))
    size = (1 << 8 * quality._BYTES.dtype.itemsize) - 1
    h = [(a + b * c1 + c * c2) & size for a, b, c in zip(t, t[1:], t[2:])]
    out += [((x * c3) & size) >> shift for x, s in zip(h, space[1:]) if not s]
    out += [(((h[i] + t[i + 3] * c3 + t[i + 4] * c4) & size) * c1 & size) >> shift for i in range(len(h) - 2) if not any(space[i + 1 : i + 4])]
    return Counter(out) if words else Counter()


def test_tokens():
    together = [Counter() for _ in TEXTS]
    for at, owner in quality.tokens(TEXTS):
        for b, i in zip(at.tolist(), owner.tolist(), strict=True):
            together[i][b] += 1
    for raw, got in zip(TEXTS, together, strict=True):
        assert got == plain_tokens(raw), raw
        alone = Counter(b for at, _ in quality.tokens([raw]) for b in at.tolist())
        assert alone == got


def test_training_and_scores():
    labels = [i % 2 for i in range(len(TEXTS))]
    weights, bias = quality.train(TEXTS, labels, epochs=2, rate=0.6, seed=11)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32)
    docs = [plain_tokens(raw) for raw in TEXTS]
    used = sorted({b for d in docs for b in d})
    v = {b: [float(x) for x in vectors[b]] for b in used}
    out, off, order, done = [[0.0] * quality.DIM for _ in "ab"], [0.0, 0.0], np.arange(len(docs)), 0
    for _ in range(2):
        rng.shuffle(order)
        for i in order:
            total = max(1, sum(docs[i].values()))
            share = {b: n / total for b, n in docs[i].items()}
            step = 0.6 * (1 - done / (2 * len(docs)))
            done += 1
            mean = [sum(share[b] * v[b][k] for b in share) for k in range(quality.DIM)]
            z = [sum(o * m for o, m in zip(out[c], mean)) + off[c] for c in (0, 1)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == labels[i]) for c, x in enumerate(e)]
            back = [p[0] * out[0][k] + p[1] * out[1][k] for k in range(quality.DIM)]
            for c in (0, 1):
                out[c] = [o - step * p[c] * m for o, m in zip(out[c], mean)]
                off[c] -= step * p[c]
            for b, s in share.items():
                v[b] = [x - step * len(share) ** 0.5 * s * g for x, g in zip(v[b], back)]
    own = {b: sum(x * (out[1][k] - out[0][k]) for k, x in enumerate(v[b])) for b in used}
    assert abs(bias - (off[1] - off[0])) < 1e-5
    assert max(abs(float(weights[b]) - own[b]) for b in used) < 1e-5
    want = [off[1] - off[0] + sum(n * own[b] for b, n in d.items()) / max(1, sum(d.values())) for d in docs]
    assert np.allclose(quality.margins(TEXTS, weights, bias), want, atol=1e-5)
    assert common.SPACED[ord(" ")] and not common.SPACED[0]
