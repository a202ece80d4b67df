"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads whole texts as UTF-8 (A-Z in lower case) and labels every byte, from a state carried forward and one
carried backward. It is trained in numpy by backpropagation through time on windows drawn from whole texts. A
document's probabilities pool the logarithms of the label probabilities over all its positions.

Texts are read in spans, so that a task can take many steps at once: a span's states start CONTEXT bytes before and
after it, long after which they have forgotten where they began. Spans depend on the text alone.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_chunks, cut, fold, small, text_list

HIDDEN, SPAN, CONTEXT = 8, 1024, 64
#: Learning takes at most so many documents of each language (those of the smallest id hash) and windows of so many bytes from each,
#: and takes steps of so many windows.
TRAIN_DOCS, WINDOWS, WINDOW, STEPS, BATCH = 1000, 16, 64, 400, 192
#: So many chosen ids (of about 30 bytes) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def layout(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (step, piece), and a mask of the same shape."""
    lengths = np.array([len(p) for p in pieces])
    mask = np.arange(lengths.max())[:, None] < lengths
    at = np.zeros(mask.shape, np.uint8)
    at.T[mask.T] = np.frombuffer(b"".join(pieces), np.uint8)
    return at, mask


class BiGRU:
    """Forward and backward cells on byte vectors, and a softmax layer on both states at each position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.p = {f"{kind}{side}": value for side in "fb" for kind, value in (("x", draw(256, 3 * hidden)), ("u", draw(hidden, 3 * hidden)), ("c", np.zeros(hidden, np.float32)))}
        self.p |= {"v": draw(2 * hidden, len(labels)), "o": np.zeros(len(labels), np.float32)}

    def _run(self, side: str, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step; where the mask is off the state stays. The backward side reads from the end."""
        n = self.hidden
        x, u, c = self.p["x" + side], self.p["u" + side], self.p["c" + side]
        h = np.zeros((at.shape[1], n), np.float32)
        states, kept = np.empty((*at.shape, n), np.float32), []
        for t in range(len(at)) if side == "f" else range(len(at) - 1, -1, -1):
            before, a, r_u = h, x[at[t]], h @ u
            rz = _sigmoid(a[:, : 2 * n] + r_u[:, : 2 * n])
            r, z = rz[:, :n], rz[:, n:]
            inner = r_u[:, 2 * n :] + c
            new = np.tanh(a[:, 2 * n :] + r * inner)
            on = mask[t][:, None]
            h = np.where(on, new + z * (before - new), before)
            states[t] = h
            kept.append((t, before, r, z, inner, new, on))
        return states, kept

    def log_probs(self, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", at, mask)[0], self._run("b", at, mask)[0]], axis=2)
        z = both @ self.p["v"] + self.p["o"]
        z -= z.max(axis=2, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=2, keepdims=True))

    def gradients(self, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Backpropagation through time of the mean cross-entropy over positions; y has the label of each piece."""
        n, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, kf), (hb, kb) = self._run("f", at, mask), self._run("b", at, mask)
        both = np.concatenate([hf, hb], axis=2)
        z = both @ self.p["v"] + self.p["o"]
        z -= z.max(axis=2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=2, keepdims=True)
        total = mask.sum()
        picked = np.take_along_axis(p, np.broadcast_to(y, at.shape)[..., None], 2)[..., 0]
        loss = float(-(np.log(picked + 1e-12) * mask).sum() / total)
        d = p
        np.put_along_axis(d, np.broadcast_to(y, at.shape)[..., None], picked[..., None] - 1, 2)
        d = d * mask[..., None] / total
        flat = d.reshape(-1, d.shape[2])
        g["v"], g["o"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        back = d @ self.p["v"].T
        for side, kept, part in (("f", kf, back[..., :n]), ("b", kb, back[..., n:])):
            u, carry, d_x = self.p["u" + side], np.zeros((at.shape[1], n), np.float32), np.empty((*at.shape, 3 * n), np.float32)
            for t, before, r, z, inner, new, on in reversed(kept):
                dh = carry + part[t]
                live = np.where(on, dh, 0)
                d_new = live * (1 - z) * (1 - new * new)
                d_z = live * (before - new) * z * (1 - z)
                d_inner = d_new * r
                d_r = d_new * inner * r * (1 - r)
                gates = np.concatenate([d_r, d_z, d_inner], axis=1)
                d_x[t] = np.concatenate([d_r, d_z, d_new], axis=1)
                g["u" + side] += before.T @ gates
                g["c" + side] += d_inner.sum(axis=0)
                carry = np.where(on, live * z, dh) + gates @ u.T
            order = np.argsort(at, axis=None, kind="stable")
            read, first = np.unique(at.reshape(-1)[order], return_index=True)
            g["x" + side][read] = np.add.reduceat(d_x.reshape(-1, 3 * n)[order], first, axis=0)
        return g, loss

    def train(self, pieces: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 3) -> float:
        """Adam over random pieces; pieces of like length go together, so that little of a step is padding."""
        rng = np.random.default_rng(seed)
        by_length = np.argsort([len(p) for p in pieces], kind="stable")
        m, s, loss = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0
        for i in range(1, steps + 1):
            a = rng.integers(0, max(1, len(pieces) - batch + 1))
            chosen = by_length[a : a + batch]
            at, mask = layout([pieces[k] for k in chosen])
            g, loss = self.gradients(at, mask, y[chosen])
            step = rate * (1 - (i - 1) / steps) + 1e-4
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= (step * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return loss

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels, dtype=str), **self.p)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> BiGRU:
        with np.load(io.BytesIO(raw)) as held:
            out = BiGRU([str(x) for x in held["labels"]], held["cf"].shape[0])
            out.p = {k: held[k] for k in out.p}
        return out


class Labeller:
    """Sums of log probabilities over all positions of texts, by the same network as BiGRU.log_probs, many spans a step."""

    def __init__(self, net: BiGRU) -> None:
        self.net, n = net, net.hidden
        # With q(x) = 1 / (1 + exp(x)) a sigmoid is q(-x) and a tanh 1 - 2 q(2 x); the factors are put into the weights.
        factor = np.concatenate([np.full(2 * n, -1, np.float32), np.full(n, 2, np.float32)])
        self.x = {s: np.ascontiguousarray((net.p["x" + s] * factor).T) for s in "fb"}
        self.u = {s: np.ascontiguousarray((net.p["u" + s] * factor).T) for s in "fb"}
        self.c = {s: 2 * net.p["c" + s][:, None] for s in "fb"}
        self.v = {"f": np.ascontiguousarray(net.p["v"][:n].T), "b": np.ascontiguousarray(net.p["v"][n:].T)}

    def _project(self, side: str, rows: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The share of this side in the outputs, (label, cell), and for each row its cells in order. Step t has the rows longer than t, the longest first."""
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(-lengths, kind="stable")
        live = len(rows) - np.cumsum(np.bincount(lengths))[:-1]
        base = np.concatenate([[0], np.cumsum(live)])
        held, cells = np.empty(base[-1], np.intp), [np.zeros(0, np.intp)] * len(rows)
        for rank, i in enumerate(order):
            cells[i] = base[: lengths[i]] + rank
            held[cells[i]] = np.frombuffer(rows[i], np.uint8)
        n, x, u, c = self.net.hidden, self.x[side], self.u[side], self.c[side]
        h = np.zeros((n, len(rows)), np.float32)
        states = np.empty((n, base[-1]), np.float32)
        for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
            if b - a < h.shape[1]:
                h = np.ascontiguousarray(h[:, : b - a])
            read, back = np.take(x, held[a:b], axis=1, mode="clip"), u @ h  # take keeps rows together, which x[:, ...] does not
            gates = read[: 2 * n]
            gates += back[: 2 * n]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new, inner = read[2 * n :], back[2 * n :]
            inner += c
            inner *= gates[:n]
            new += inner
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            h -= new
            h *= gates[n:]
            h += new
            states[:, a:b] = h
        return self.v[side] @ states, cells

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums by label, and the number of positions."""
        totals, positions = np.zeros((len(raws), len(self.net.labels))), np.array([len(r) for r in raws], float)
        raws = [r.lower() for r in raws]  # bytes.lower() touches A-Z only
        spans = [(i, a, min(a + SPAN, len(r))) for i, r in enumerate(raws) for a in range(0, len(r), SPAN)]
        if not spans:
            return totals, positions
        with np.errstate(over="ignore"):  # exp may be infinite, then q is 0
            forward, at_f = self._project("f", [raws[i][max(0, a - CONTEXT) : b] for i, a, b in spans])
            backward, at_b = self._project("b", [raws[i][a : b + CONTEXT][::-1] for i, a, b in spans])
        z = forward[:, np.concatenate([cells[min(a, CONTEXT) :] for (_, a, _), cells in zip(spans, at_f, strict=True)])]
        z += backward[:, np.concatenate([cells[::-1][: b - a] for (_, a, b), cells in zip(spans, at_b, strict=True)])]
        z += self.net.p["o"][:, None]
        z -= z.max(axis=0)
        z -= np.log(np.exp(z).sum(axis=0))
        filled = np.flatnonzero(positions)
        totals[filled] = np.add.reduceat(z, np.concatenate([[0], np.cumsum(positions[filled])[:-1]]).astype(np.intp), axis=1, dtype=float).T
        return totals, positions


def windows_of(raw: bytes, seed: int = 0) -> list[bytes]:
    """At most WINDOWS windows of WINDOW bytes, drawn from the whole text by its content; a shorter text is one."""
    raw = raw.lower()
    if len(raw) <= WINDOW:
        return [raw] if raw else []
    rng = np.random.default_rng([seed, zlib.crc32(raw)])
    return [raw[a : a + WINDOW] for a in rng.integers(0, len(raw) - WINDOW + 1, min(WINDOWS, len(raw) // WINDOW))]


def train_net(pieces: list[bytes], langs: list[str], steps: int = STEPS) -> BiGRU:
    """A network from labelled windows; every label is learned, each from as many windows as the most frequent has, drawn again where there are fewer."""
    labels = sorted(set(langs)) or [UNDETERMINED]
    net, rng = BiGRU(labels), np.random.default_rng(1)
    y = np.searchsorted(labels, langs)
    if len(pieces):
        most = int(np.bincount(y).max())
        chosen = rng.permutation(np.concatenate([rng.permutation(np.resize(rng.permutation(np.flatnonzero(y == k)), most)) for k in range(len(labels))]))
        net.train([pieces[i] for i in chosen], y[chosen], steps)
    return net


def fit(docs: DataFrame, modulus: int = 5, held_out: int = 0, most_docs: int = TRAIN_DOCS) -> BiGRU:
    """Train on text and lang of documents outside the held-out fold, in one task; the driver gets the network only.

    Of each language about most_docs documents at most take part, those of the smallest id hash in each of up to 64 parts,
    with at most WINDOWS * WINDOW bytes each. Null or empty texts, null languages and null ids are not learned from; without any row to learn from the
    network knows `und` only. A doc_id with several languages or texts is learned from in each of them.
    """
    usable = docs.select("doc_id", "text", "lang").where((fold("doc_id", modulus) != held_out) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != ""))
    parts = max(1, min(64, most_docs))
    part = F.pmod(F.hash("doc_id"), F.lit(parts))
    rank = F.row_number().over(W.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))  # in parts, so that one frequent language is no single task's work
    chosen = usable.select("doc_id", "lang", part.alias("part")).distinct().withColumn("rank", rank).where(F.col("rank") <= -(-most_docs // parts))
    chosen = cut(chosen.select("doc_id", "lang"))
    few = chosen.count() <= BROADCAST_IDS

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [(doc, lang, w) for doc, lang, t in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), text_list(batch), strict=True) for w in windows_of(t.encode())]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "lang", "piece"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.string()), ("lang", pa.string()), ("piece", pa.binary())]))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"doc_id": [], "lang": [], "piece": []}), *batches]).sort_values(["doc_id", "lang", "piece"])
        yield pd.DataFrame({"net": [train_net([bytes(x) for x in held["piece"]], list(held["lang"])).dump()]})

    sample = usable.join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang"], "left_semi").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    pieces = sample.mapInArrow(draw, "doc_id string, lang string, piece binary")
    return BiGRU.load(bytes(pieces.repartition(1).mapInPandas(one, "net binary").collect()[0]["net"]))


def predict(docs: DataFrame, net: BiGRU) -> DataFrame:
    """docs with lang_pred and score (the pooled probability). Null texts and texts without a letter: `und` and 0.

    Of equal probabilities the alphabetically first label is taken. Each row is labelled on its own, so rows may repeat;
    other columns stay, but for two of these names, which are replaced. An empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net.dump())
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(BiGRU.load(shared.value))
        names = labeller.net.labels
        for batch in small(batches):
            texts, langs, scores = text_list(batch), [], []
            for first, raws in byte_chunks(texts, 1 << 20):  # about 100 MB of states
                totals, positions = labeller(raws)
                z = totals / np.maximum(positions, 1)[:, None]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for i, k in enumerate(best):
                    known = bool(texts[first + i]) and _LETTER.search(texts[first + i]) is not None
                    langs.append(names[k] if known else UNDETERMINED)
                    scores.append(float(p[i, k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)
