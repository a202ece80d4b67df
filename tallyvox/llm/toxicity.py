"""Toxicity scores that see through disguises.

A token written with digits for letters, with separators between its letters or with repeated letters is taken
as the output of a noisy channel. Each token becomes a lattice of letters; a Viterbi search finds the letters of
least cost under the channel and a character trigram model, and a linear model scores the words so restored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_list

#: Letters that a digit or sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
COST_SUBSTITUTE, COST_DROP, COST_COLLAPSE, UNKNOWN = 1.0, 0.7, 0.5, 9.0
#: After so many steps the start that all paths share is put aside, so that a long token's cost grows with its length only.
FLUSH = 64
#: A feature is in so many texts of label 1 at least, and its log odds are over this.
MIN_DOCS, LEAST_ODDS = 3, 1.2
#: Half of this times a squared weight is added to the loss, which keeps weights of features that tell labels apart without fail finite.
PRIOR = 0.01
#: Names that a task tallies before it hands them on.
HELD = 200_000
_SPACED_OUT = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
_LONG_RUN = re.compile(r"(.)\1\1")
_REPEATED = re.compile(r"(.)\1")
#: What is no letter at a token's edges: signs that stand for none, and all signs.
_NO_LETTER = ".,;:?\"')[]{}<>#%&*_-~=/\\^`"
_SIGNS = _NO_LETTER + "("
_EDGES = "!$|+("


class CharModel:
    """A character trigram model with add-k smoothing over word types; its costs are negative natural logarithms."""

    def __init__(self, counts: dict[str, int], k: float = 0.1) -> None:
        self.cost: dict[str, float] = {}
        contexts: Counter[str] = Counter()
        for gram, n in counts.items():
            contexts[gram[:2]] += n
        letters = len({g[2] for g in counts}) + 1
        for gram, n in counts.items():
            self.cost[gram] = -math.log((n + k) / (contexts[gram[:2]] + k * letters))

    def __call__(self, gram: str) -> float:
        return self.cost.get(gram, UNKNOWN)

    @staticmethod
    def count(words: Iterable[str]) -> dict[str, int]:
        out: Counter[str] = Counter()
        for w in words:
            padded = f"^^{w}$"
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return dict(out)


def lattice(token: str, edges: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each run of equal characters, what it may have been meant as, with the channel's cost; with edges, the first and the last one are letters if they can be."""
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        at_edge = edges and c in STANDS_FOR and (i == 0 or j == len(token))
        n, i = j - i, j
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c, COST_COLLAPSE), (c * 2, 0.0 if n == 2 else COST_COLLAPSE)]
        else:
            options = ([] if at_edge else [("", COST_DROP)]) + [(x, COST_SUBSTITUTE) for x in STANDS_FOR.get(c, "")]
            if n > 1:
                options += [(x * 2, COST_SUBSTITUTE + COST_COLLAPSE) for x in STANDS_FOR.get(c, "")]
        yield options


def decode(token: str, model: CharModel, several: bool = False, edges: bool = False) -> str:
    """The letters of least cost through the token's lattice (ties: the alphabetically first); with several, words with spaces between."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    done = []
    for step, options in enumerate(lattice(token, edges), 1):
        after: dict[str, tuple[float, str]] = {}
        for context, (cost, path) in best.items():
            for letters, price in options:
                total, state = cost + price, context
                for x in letters:
                    total += model(state + x)
                    state = state[1] + x
                found = (total, path + letters)
                if state not in after or found < after[state]:
                    after[state] = found
        if several:  # a word may end here
            ended = [(cost + model(state + "$"), path + " ") for state, (cost, path) in after.items() if state != "^^"]
            if ended:
                after["^^"] = min(ended + [after["^^"]] if "^^" in after else ended)
        best = after
        if step % FLUSH == 0:
            shared = len(os.path.commonprefix([path for _, path in best.values()]))
            done.append(next(iter(best.values()))[1][:shared])
            best = {state: (cost, path[shared:]) for state, (cost, path) in best.items()}
    last = min((cost if several and state == "^^" else cost + model(state + "$"), path) for state, (cost, path) in best.items())[1]
    return "".join(done) + last


class Restorer:
    """Features of restored words; remembers tokens, and forgets all of them when there are too many. Of weights, if given, only its keys are features."""

    def __init__(self, model: CharModel, weights: dict | None = None, remember: int = 200_000) -> None:
        self.model, self.weights, self.remember = model, weights, remember
        self.known: dict[str, tuple[str, ...]] = {}
        names = self.names = list(weights or ())
        self.whole = {f for f in names if not f.endswith("~")}
        self.stems = {f[:-1] for f in names if f.endswith("~")}
        self.starts = {f[:n] for f in (*self.whole, *self.stems) for n in range(len(f) + 1)}

    def words(self, token: str) -> list[str]:
        """What one token may say: as it is written, and restored without, with and only with letters for the signs at its edges; none if it has no letters."""
        token = token.lower()
        whole = token.strip(_NO_LETTER)
        core = token.strip(_SIGNS)
        core = core.rstrip("!$|+") or core
        found = [core] if core.isalpha() and not _LONG_RUN.search(core) else []
        if not (core.isalpha() and not _REPEATED.search(core)):  # else the lattice has one path
            found += self.restored(core)
        if whole != core or whole.startswith(tuple(_EDGES)):
            found += self.restored(whole)
            for part in dict.fromkeys((whole, whole.lstrip(_EDGES), whole.rstrip(_EDGES))):
                found += self.restored(part, edges=True)
        return list(dict.fromkeys(found))

    def restored(self, token: str, **how: bool) -> list[str]:
        if self.names and "several" not in how and not self.may_say(token, **how):
            return []
        return decode(token, self.model, **how).split() if any(c.isalpha() or c in STANDS_FOR for c in token) else []

    def may_say(self, token: str, edges: bool = False) -> bool:
        """Whether any way through the lattice is a feature or begins with one. If none is, the cheapest way is none either and need not be found."""
        heads = {""}
        for options in lattice(token, edges):
            after = set()
            for head in heads:
                for letters, _ in options:
                    longer = head + letters
                    if longer in self.starts:
                        after.add(longer)
                    if longer[:5] in self.stems:
                        return True
            heads = after
            if not heads:
                return False
        return not heads.isdisjoint(self.whole)

    def features(self, token: str) -> tuple[str, ...]:
        """A restored word, and the first five letters of a longer one; of letters with spaces between, of the one word and of the likeliest words that they make."""
        if len(self.known) >= self.remember:
            self.known.clear()
        if self.names:
            low = token.lower()
            core = low.strip(_NO_LETTER)
            if core.isalpha() and not _REPEATED.search(core):  # one way to read it, which words() would find by the same steps
                kept = (core,) if core in self.whole else ()
                if len(core) > 5 and core[:5] in self.stems:
                    kept += (f"{core[:5]}~",)
                self.known[token] = kept
                return kept
        letters = "".join(token.split())
        words = self.words(letters)
        if self.weights is None:
            words = words[:1]  # features are chosen from the plainest reading; weights come from all
        if letters != token:
            words = list(dict.fromkeys(words + self.restored(letters.lower(), several=True)))
        found = words + [f"{w[:5]}~" for w in words if len(w) > 5]
        kept = tuple(found if self.weights is None else (f for f in found if f in self.weights))
        self.known[token] = kept
        return kept

    def __call__(self, text: str | None) -> set[str]:
        """The distinct features of a whole text; null and empty texts have none."""
        out: set[str] = set()
        tokens, known = set((text or "").split()), self.known
        for t in tokens:
            found = known.get(t)
            if found is None:
                found = self.features(t)
            if found:
                out.update(found)
        if sum(len(t) == 1 for t in tokens) > 1:  # a word spelled out has two different letters at least
            for m in _SPACED_OUT.finditer(text):
                spaced = " ".join(m[0].split())
                found = self.known.get(spaced)
                out.update(self.features(spaced) if found is None else found)
        return out


def _words(text: str | None) -> set[str]:
    return {w for w in (text or "").lower().split() if w.isalpha()}


def _odds(n1: int, n0: int, toxic: int, other: int) -> float:
    """How much likelier a feature is in texts of label 1 (n1 of toxic) than of label 0 (n0 of other), as a logarithm."""
    return math.log((n1 + 0.3) / (max(1, toxic) + 0.6)) - math.log((n0 + 0.3) / (max(1, other) + 0.6))


def _constant(toxic: int, other: int) -> float:
    """The margin of every text where there is nothing to tell texts apart by."""
    rate = min(max(toxic / (toxic + other), 0.01), 0.99) if toxic + other else 0.5
    return math.log(rate / (1 - rate))


def _model(grams: dict[str, int], chosen: list[str], weights: Iterable[float], bias: float) -> dict:
    return {"grams": grams, "weights": {f: round(float(w), 5) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}, "bias": float(bias)}


def _least_loss(rows: list[np.ndarray], y: np.ndarray, k: int) -> np.ndarray:
    """k weights and a bias of least logistic loss, plus PRIOR / 2 for each squared weight: Newton steps found by conjugate gradients."""
    at, owner = np.concatenate([*rows, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    margin = lambda w: w[k] + np.bincount(owner, w[at], len(rows))
    back = lambda e, w: np.append(np.bincount(at, e[owner], k) + PRIOR * w[:k], e.sum())
    loss = lambda w: np.logaddexp(0, z := margin(w)).sum() - y @ z + PRIOR / 2 * w[:k] @ w[:k]
    w = np.zeros(k + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(margin(w), -500, 500)))
        grad = back(p - y, w)
        if np.abs(grad).max() < 1e-7:
            break
        step, left = np.zeros(k + 1), grad.copy()
        along, size = left.copy(), left @ left
        for _ in range(2 * (k + 1)):
            bent = back(p * (1 - p) * margin(along), along)
            far = size / (along @ bent)
            step, left = step + far * along, left - far * bent
            before, size = size, left @ left
            if size < 1e-20 * (grad @ grad):
                break
            along = left + size / before * along
        now, share = loss(w), 1.0
        while share > 1e-6 and loss(w - share * step) > now:
            share /= 2
        w = w - share * step
    return w


def train(texts: list[str | None], labels: list[int], min_docs: int = MIN_DOCS) -> dict:
    """Learn the character model, the features and their weights from labelled texts that fit into one process; fit() does the same by Spark jobs. Without both labels the score is a constant."""
    grams = CharModel.count({w for t in texts for w in _words(t)})
    restorer = Restorer(CharModel(grams))
    df1, df0 = Counter(), Counter()
    for t, label in zip(texts, labels, strict=True):
        (df1 if label else df0).update(restorer(t))
    toxic, other = sum(map(bool, labels)), len(labels) - sum(map(bool, labels))
    chosen = sorted(f for f in df1 if df1[f] >= min_docs and _odds(df1[f], df0[f], toxic, other) > LEAST_ODDS) if toxic and other else []
    if not chosen:
        return _model(grams, [], [], _constant(toxic, other))
    at = {f: i for i, f in enumerate(chosen)}
    restorer = Restorer(restorer.model, at)
    w = _least_loss([np.sort(np.fromiter((at[f] for f in restorer(t)), int)) for t in texts], np.asarray(labels, float), len(chosen))
    return _model(grams, chosen, w[:-1], w[-1])


def _tallied(rows: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, int, int]]]) -> DataFrame:
    """(name, n1, n0) summed over what entries gives for the batches of a task, which holds at most HELD names."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array([n[i] for n in held.values()], pa.int64()) for i in (0, 1))], ["name", "n1", "n0"])
        for name, n1, n0 in entries(batches):
            if (n := held.get(name)) is None:
                if len(held) >= HELD:
                    yield out()
                    held.clear()
                held[name] = [n1, n0]
            else:
                n[0] += n1
                n[1] += n0
        if held:
            yield out()

    return rows.mapInArrow(tally, "name string, n1 long, n0 long").groupBy("name").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fit(rows: DataFrame, min_docs: int = MIN_DOCS) -> dict:
    """Learn from all rows (text, y), y 0 or 1, what train() learns from a list: counts of trigrams and features by Spark, weights by its logistic regression.

    The rows are written to the checkpoint folder, as three passes read them. The driver gets the model only.
    """
    rows = cut(rows.select("text", "y"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in small(batches):
            for text in text_list(batch):
                yield from ((w, 1, 0) for w in _words(text))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in small(batches):
            for word in text_list(batch, "name"):
                yield from ((gram, n, 0) for gram, n in CharModel.count([word]).items())

    grams = {r["name"]: r["n1"] for r in _tallied(_tallied(rows, words).select("name"), trigrams).collect()}
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, other = count.get(1, 0), count.get(0, 0)
    if not (toxic and other):
        return _model(grams, [], [], _constant(toxic, other))
    spark = rows.sparkSession
    plain = spark.sparkContext.broadcast(grams)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        restorer = Restorer(CharModel(plain.value))
        for batch in small(batches):
            for text, y in zip(text_list(batch), text_list(batch, "y"), strict=True):
                yield from ((f, y, 1 - y) for f in restorer(text))

    often = _tallied(rows, found).where(F.col("n1") >= min_docs)
    likelier = F.log((F.col("n1") + 0.3) / (toxic + 0.6)) - F.log((F.col("n0") + 0.3) / (other + 0.6))
    chosen = sorted(r["name"] for r in often.where(likelier > LEAST_ODDS - 1e-6).collect() if _odds(r["n1"], r["n0"], toxic, other) > LEAST_ODDS)
    if not chosen:
        return _model(grams, [], [], _constant(toxic, other))
    features = spark.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = features.value
        restorer = Restorer(CharModel(plain.value), at)
        for batch in small(batches):
            ids = [sorted(at[f] for f in restorer(text)) for text in text_list(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column("y")], ["ids", "y"])

    k = len(chosen)
    vector = F.udf(lambda ids: Vectors.sparse(k, ids, [1.0] * len(ids)), VectorUDT())
    alike = rows.select("text", "y").mapInArrow(numbered, "ids array<int>, y int").groupBy("ids", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    alike = cut(alike)  # the regression asks for its rows several times
    points = alike.select(vector("ids").alias("features"), F.col("y").cast("double").alias("label"), "n")
    learned = LogisticRegression(regParam=PRIOR / (toxic + other), standardization=False, weightCol="n", tol=1e-10, maxIter=300).fit(points)
    return _model(grams, chosen, learned.coefficients.toArray(), learned.intercept)


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1, null and empty texts too) and predicted (score >= threshold) to every row; other columns stay, but for two of these names.

    Each row is scored by its text alone, so rows may repeat and equal texts get equal scores; a score of just the
    threshold is predicted as 1. An empty table stays empty. A model that was trained without both labels gives one
    score to all texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, bias = m["weights"], m["bias"]
        restorer = Restorer(CharModel(m["grams"]), weights)
        for batch in small(batches):
            out = []
            for text in text_list(batch, text_col):
                z = bias + math.fsum(weights[f] for f in restorer(text))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
