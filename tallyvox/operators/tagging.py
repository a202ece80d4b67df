"""Scores of labels for reviews by what their sentences say, and the choice of labels that follows.

A catalog is small; it travels with the tasks, which score every review against it in Arrow batches. Thresholds,
conflicts between the sides and repeats of a concept are DataFrame steps on the scored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CONTRAST, OVERALL_LABELS
from ..functions.negation import is_negated
from ..functions.wording import fragments, plain, says, stem

#: Words and phrases of a concept: what names it, what praises it, what blames it. A table of our own; pass another to score by it.
CONCEPTS = {
    "noise": (["noise", "noisy", "loud", "quiet", "sound"], ["quiet", "silent", "low noise", "whisper quiet", "runs quietly"], ["loud", "noisy", "too loud", "noise", "deafening", "wakes everyone"]),
    "cleaning": (["clean", "cleaning", "cleanup", "wash"], ["easy to clean", "cleans easily", "easy cleanup", "dishwasher safe", "wipes clean"], ["hard to clean", "difficult to clean", "messy cleanup", "pain to clean", "impossible to clean"]),
    "use": (["use", "intuitive", "controls", "operate"], ["easy to use", "simple to use", "user friendly", "intuitive", "straightforward"], ["hard to use", "difficult to use", "confusing", "complicated", "awkward"]),
    "battery": (["battery", "charge", "charging", "runtime"], ["long battery life", "holds a charge", "charges quickly", "battery lasts"], ["battery dies", "short battery life", "won't charge", "doesn't hold a charge", "dies quickly"]),
    "setup": (["setup", "assembly", "install", "installation"], ["easy setup", "easy to set up", "easy to assemble", "easy install"], ["hard to set up", "difficult setup", "hard to assemble", "assembly was hard"]),
    "size": (["size", "fit", "fits", "bulky", "compact"], ["fits perfectly", "right size", "compact", "true to size"], ["too big", "too small", "runs small", "does not fit", "doesn't fit", "bulky"]),
    "weight": (["weight", "heavy", "lightweight"], ["lightweight", "light to carry"], ["heavy", "too heavy", "weighs a ton"]),
    "value": (["value", "price", "money", "cost"], ["good value", "great value", "worth the price", "worth every penny", "affordable"], ["overpriced", "expensive", "not worth", "waste of money", "too expensive"]),
    "durability": (["durable", "durability", "quality", "broke", "sturdy"], ["durable", "sturdy", "well made", "well built", "built to last"], ["broke", "broken", "stopped working", "fell apart", "flimsy", "cheaply made", "died after"]),
    "speed": (["speed", "fast", "slow", "quick"], ["fast", "quick", "in minutes"], ["slow", "takes forever", "takes too long"]),
    "smell": (["smell", "scent", "odor"], ["smells great", "nice scent", "no odor"], ["bad smell", "smells awful", "chemical smell", "stinks"]),
    "instructions": (["instructions", "manual", "directions"], ["clear instructions", "easy to follow"], ["confusing instructions", "poor instructions", "unclear instructions", "no instructions"]),
    "performance": (["performance", "performs", "works", "results", "suction", "power"], ["works great", "works well", "performs well", "powerful", "strong suction", "great results"], ["doesn't work", "does not work", "weak suction", "no power", "poor results"]),
    "comfort": (["comfort", "comfortable"], ["comfortable", "comfy", "soft"], ["uncomfortable", "hurts", "painful"]),
    "overall": (["overall", "satisfaction", "dissatisfaction"], ["love it", "love this", "would recommend", "highly recommend", "very happy", "so happy"], ["hate it", "would not recommend", "very disappointed", "disappointed", "regret", "returned it"]),
}
#: Strong words of either side.
STRONG = {
    "delighter": ["love", "loved", "amazing", "awesome", "fantastic", "excellent", "perfect", "best", "highly recommend", "obsessed"],
    "detractor": ["hate", "terrible", "awful", "horrible", "worst", "useless", "garbage", "disappointed", "regret", "waste"],
}
#: Words of a label that fit any concept.
GENERIC = {stem(w) for w in "easy hard difficult good bad poor great nice high low long short fast slow well works issue issues problem problems quality product very too more".split()}
TURNING = [*CONTRAST, "used to", "at first", "after a while", "over time"]


@dataclass(frozen=True)
class TagConfig:
    """Thresholds, and what each sign adds to or takes from a score."""

    keep: float = 1.10
    keep_small: float = 1.35
    add: float = 2.00
    add_small: float = 2.25
    small_catalog: int = 6
    evidence: tuple[float, float, float] = (1.75, 0.40, 1.00)  # once, for each, at most
    cues: tuple[float, float, float] = (1.25, 0.55, 1.25)
    coverage: tuple[float, float] = (0.90, 0.60)  # from half, from 0.8
    opposite: tuple[float, float] = (1.80, 1.20)  # without and with evidence
    opposite_denied: tuple[float, float] = (2.25, 1.50)  # without and with cues
    denied: tuple[float, float] = (2.00, 2.50)
    strong: tuple[float, float, float] = (0.35, 0.55, 0.25)  # other, overall, with a word of the concept
    stars: tuple[float, float] = (0.20, 0.85)
    length: tuple[float, float] = (0.10, 0.20)  # from 15 words, from 30
    support_floor: float = -0.50
    repeat_margin: float = 1.50
    conflict_margin: float = 0.75
    per_side: int = 10


def concept_of(label: str, aliases: list[str] = (), concepts: dict = CONCEPTS) -> str | None:
    """The concept whose word or phrase the label or an alias holds, the longest first; ties in the order of the table."""
    if label in OVERALL_LABELS:
        return "overall"
    texts, best = [plain(x) for x in (label, *aliases)], (0, None)
    for name, (words, good, bad) in concepts.items():
        for phrase in (*words, *good, *bad):
            if len(phrase) > best[0] and any(says(phrase, t) for t in texts):
                best = (len(phrase), name)
    return best[1]


def _words(text: str) -> set[str]:
    return {stem(w) for w in plain(text).split() if len(w) > 2}


@dataclass
class Entry:
    """A label of the catalog with what to look for."""

    label: str
    side: str
    concept: str | None
    cues: list[str]
    opposite: list[str]
    keywords: list[str]
    words: set[str] = field(default_factory=set)


def prepare_catalog(rows: list[tuple[str, str, list[str]]], concepts: dict = CONCEPTS) -> list[Entry]:
    """Entries from (label, side, aliases); side is detractor or delighter."""
    out = []
    for label, side, aliases in rows:
        concept = concept_of(label, list(aliases or []), concepts)
        words, good, bad = concepts.get(concept, ((), (), ()))
        own, other = (good, bad) if side == "delighter" else (bad, good)
        cues = list(dict.fromkeys(p for p in map(plain, (label, *(aliases or []), *own)) if p))
        own_words = _words(label)
        out.append(Entry(label, side, concept, cues, [plain(p) for p in other], list(words), (own_words - GENERIC if concept else own_words) or own_words))
    return out


def evidence_supports(entry: Entry, evidence: str) -> bool:
    """Whether a quoted span is about the label: its words, a word of its concept, or a phrase of its side that is not denied."""
    text = plain(evidence)
    if not text:
        return False
    if any(says(c, text) and not is_negated(c, evidence) for c in entry.cues) or entry.words & _words(evidence):
        return True
    if any(says(k, text) for k in entry.keywords):
        return True
    if entry.concept == "overall" and any(says(w, text) for w in STRONG[entry.side]):
        return True
    return "missing" in plain(entry.label).split() and any(says(p, text) for p in ("missing", "not included", "left out", "without the", "didn't come with"))


def _score_fragment(entry: Entry, piece: str, quoted: list[str], c: TagConfig) -> tuple:
    text = plain(piece)
    given = [q for q in quoted if says(plain(q), text) and evidence_supports(entry, q)]
    found = [p for p in entry.cues if says(p, text)]
    denied = [p for p in found if is_negated(p, piece)]
    hits = [p for p in found if p not in denied]
    coverage = len(entry.words & _words(piece)) / len(entry.words) if entry.words else 0.0
    score = 0.0
    for got, (once, each, most) in ((given, c.evidence), (hits, c.cues)):
        if got:
            score += once + min(most, each * len(got))
    score += (c.coverage[0] if coverage >= 0.5 else 0) + (c.coverage[1] if coverage >= 0.8 else 0)
    other = [p for p in entry.opposite if says(p, text)]
    other_denied = [p for p in other if is_negated(p, piece)]
    # A longer phrase of this side that holds the other side's phrase speaks for this side only.
    other = [p for p in other if p not in other_denied and not any(says(p, h) for h in hits)]
    if other:
        score -= c.opposite[bool(given)]
    if other_denied:
        score += c.opposite_denied[bool(hits)]
    if denied:
        score -= c.denied[bool(hits)]
    overall = entry.concept == "overall"
    if (overall or score > 0 or coverage >= 0.3 or hits or given) and any(says(w, text) for w in STRONG[entry.side]):
        score += c.strong[overall] + (c.strong[2] if any(says(k, text) for k in entry.keywords) else 0)
    if hits or given:
        n = len(piece.split())
        score += c.length[1] if n >= 30 else c.length[0] if n >= 15 else 0
    evidence = sorted({*given, *hits, *other_denied}, key=lambda x: (-len(x), x))
    kept: list[str] = []
    for e in evidence:
        if not any(plain(e) in plain(k) for k in kept):
            kept.append(e)
    return round(score, 4), coverage, len(kept[:2]), len(hits), kept[:2], bool(other or other_denied)


def score_label(entry: Entry, text: str | None, rating: float | None = None, quoted: list[str] = (), config: TagConfig = TagConfig()) -> dict:
    """The score of a label for one review: that of its best fragment or of the whole text, with a little for fitting stars."""
    text = text or ""
    pieces = [text, *[f for f in fragments(text) if plain(f) != plain(text)]]
    score, coverage, _, hits, evidence, _ = max((_score_fragment(entry, p, list(quoted), config) for p in pieces), key=lambda x: x[:4])
    signal = 0.0
    if rating is not None and rating == rating:
        distance = rating - 3 if entry.side == "delighter" else 3 - rating
        if entry.concept == "overall" and distance > 0:
            signal = round(min(config.stars[1], distance / 2 * config.stars[1]), 3)
        elif entry.concept != "overall" and score > 0 and distance >= 1.5:
            signal = round((distance - 1) * config.stars[0], 3)
    score = round(score + signal, 4)
    support = bool(evidence or hits or (coverage >= 0.5 and score >= 0.75) or coverage >= 0.8)
    if entry.concept == "overall" and score > 0.4 and any(says(w, plain(text)) for w in STRONG[entry.side]):
        support = True
    return {"score": score, "coverage": coverage, "cue_hits": hits, "evidence": evidence, "rating_signal": signal if entry.concept == "overall" else 0.0, "has_support": support and score > config.support_floor}


class Remembered:
    """A function of single texts that remembers what it gave for the last ones, up to so many characters of them."""

    def __init__(self, work: Callable, most: int = 4_000_000) -> None:
        self.work, self.most, self.held, self.known = work, most, 0, {}

    def __call__(self, *key: object) -> object:
        found = self.known.get(key)
        if found is None:
            if self.held > self.most:
                self.known, self.held = {}, 0
            found = self.known[key] = self.work(*key)
            self.held += 200 + sum(len(x) for x in key if isinstance(x, str))
        return found


SCORED = "review_id string, side string, label string, concept string, position int, score double, coverage double, cue_hits int, evidence array<string>, rating_signal double, has_support boolean, turns boolean"


def score_tags(reviews: DataFrame, catalog: list[tuple[str, str, list[str]]], config: TagConfig = TagConfig(), concepts: dict = CONCEPTS) -> DataFrame:
    """A row for each label of the catalog that a review (review_id, review_text, rating, and quoted array<struct<label, evidence>> if it has it) says anything about.

    Labels without any sign in a review give no row, so the result grows with what is said, not with the catalog. What
    is said again, with the same stars, is not scored again while a task remembers it. Null
    and empty texts give none. position is the label's place in the catalog, turns says whether the review turns.
    """
    entries = prepare_catalog(catalog, concepts)
    if "quoted" not in reviews.columns:
        reviews = reviews.withColumn("quoted", F.lit(None).cast("array<struct<label:string,evidence:string>>"))
    columns = [c.split()[0] for c in SCORED.split(", ")]

    def signs(text: str, rating: float | None, quoted: tuple[tuple[str, str], ...]) -> list[tuple]:
        said, words = plain(text), _words(text)
        spans: dict[str, list[str]] = {}
        for label, evidence in quoted:
            spans.setdefault(label, []).append(evidence)
        turns = any(says(t, said) for t in TURNING)
        rows = []
        for i, e in enumerate(entries):
            if e.label not in spans and e.concept != "overall" and not (e.words & words) and not any(c in said for c in e.cues) and not any(p in said for p in e.opposite):
                continue
            r = score_label(e, text, rating, spans.get(e.label, []), config)
            if r["score"] or r["cue_hits"] or r["coverage"]:
                rows.append((e.side, e.label, e.concept, i, r["score"], r["coverage"], r["cue_hits"], r["evidence"], r["rating_signal"], r["has_support"], turns))
        return rows

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(signs)
        for frame in frames:
            rows = []
            for review_id, text, rating, quoted in frame.itertuples(index=False):
                if isinstance(text, str) and text.strip():
                    spans = tuple((q["label"], q["evidence"]) for q in quoted) if quoted is not None else ()
                    rows += [(review_id, *r) for r in known(text, rating if rating == rating else None, spans)]
            yield pd.DataFrame(rows, columns=columns)

    return reviews.select(F.col("review_id").cast("string"), F.col("review_text").cast("string"), F.col("rating").cast("double"), "quoted").mapInPandas(score, SCORED)


def refine_tags(scored: DataFrame, selected: DataFrame, catalog_size: int, config: TagConfig = TagConfig()) -> DataFrame:
    """A row per review: dets, dels, evidence, and the labels added to and removed from selected (review_id, side, label).

    Selected labels stay if they reach their threshold or have support; others come in if they score high; a label of
    overall feeling comes in on strong words and stars. Where both sides keep labels of one concept and the review
    neither turns nor quotes different spans, the side that is better by a margin stays, else the one with more
    evidence, else the detractors. Of one concept on one side the labels with support stay, or if none has it the
    first, unless another is far better. Overall labels go where others stay. At most per_side labels stay on a side.
    """
    small = catalog_size <= config.small_catalog
    keep, add = (config.keep_small, config.add_small) if small else (config.keep, config.add)
    chosen = selected.select(F.col("review_id").cast("string").alias("review_id"), "side", "label").distinct().withColumn("selected", F.lit(True))
    rows = scored.join(chosen, ["review_id", "side", "label"], "full_outer").withColumns(
        {"selected": F.coalesce("selected", F.lit(False)), "score": F.coalesce("score", F.lit(0.0)), "coverage": F.coalesce("coverage", F.lit(0.0)), "has_support": F.coalesce("has_support", F.lit(False)), "evidence": F.coalesce("evidence", F.array().cast("array<string>")), "cue_hits": F.coalesce("cue_hits", F.lit(0)), "rating_signal": F.coalesce("rating_signal", F.lit(0.0)), "position": F.coalesce("position", F.lit(1 << 30))}
    ).repartition("review_id")  # all windows below lie inside a review, so the rows move once
    some, bare = F.size("evidence") > 0, F.col("concept").isNull()
    less = lambda when, x: F.when(when, x).otherwise(0.0)
    keep_at = F.greatest(keep - less(some, 0.20) - less(F.col("coverage") >= 0.4, 0.10) + less(bare, 0.15), F.lit(0.70))
    add_at = F.greatest(add - less(some, 0.25) + less(bare, 0.25), F.lit(1.50))
    overall = F.coalesce(F.col("concept") == "overall", F.lit(False))
    rescued = overall & (F.col("score") >= max(2.0, keep)) & ((F.col("cue_hits") > 0) | (F.col("coverage") >= 0.5) | (F.col("rating_signal") > 0))
    kept = F.when(F.col("selected"), (F.col("score") >= keep_at) | F.col("has_support")).otherwise((F.col("score") >= add_at) | rescued)
    rows = rows.withColumn("kept", kept)

    by = Window.partitionBy("review_id", "concept")
    concept = F.col("concept").isNotNull() & F.col("kept")
    best = lambda side: F.max(F.when(concept & (F.col("side") == side), F.struct("score", (F.size("evidence") + F.col("cue_hits")).alias("n"), "evidence"))).over(by)
    rows = rows.withColumns({"d": best("detractor"), "l": best("delighter")})
    differ = (F.size("d.evidence") > 0) & (F.size("l.evidence") > 0) & (F.array_sort("d.evidence") != F.array_sort("l.evidence"))
    gap = F.col("d.score") - F.col("l.score")
    loser = F.when(gap >= config.conflict_margin, "delighter").when(gap <= -config.conflict_margin, "detractor").when(F.col("d.n") >= F.col("l.n"), "delighter").otherwise("detractor")
    clash = concept & F.col("d").isNotNull() & F.col("l").isNotNull() & ~differ & ~F.coalesce("turns", F.lit(False))
    rows = rows.withColumn("kept", F.col("kept") & ~F.coalesce(clash & (F.col("side") == loser), F.lit(False))).drop("d", "l")

    one = Window.partitionBy("review_id", "side", "concept")
    order = [F.desc("selected"), F.asc("position"), F.asc("label")]
    live = F.col("kept")
    rows = rows.withColumns({
        "supported": F.max(F.when(live, F.col("has_support"))).over(one), "first": F.min(F.when(live, F.struct((~F.col("selected")).alias("s"), "position", "label"))).over(one),
        "top": F.max(F.when(live, F.struct("score", (-F.col("position")).alias("p"), "label"))).over(one),
    })
    first_score = F.max(F.when(live & (F.col("label") == F.col("first.label")), F.col("score"))).over(one)
    rows = rows.withColumn("first_score", first_score)
    winner = F.when(F.col("top.score") > F.col("first_score") + config.repeat_margin, F.col("top.label")).otherwise(F.col("first.label"))
    unique = bare | overall | F.when(F.col("supported"), F.col("has_support")).otherwise(F.col("label") == winner)
    rows = rows.withColumn("kept", F.col("kept") & unique)

    side = Window.partitionBy("review_id", "side")
    specific = F.max(F.col("kept") & ~F.col("label").isin(OVERALL_LABELS)).over(side)
    rows = rows.withColumn("kept", F.col("kept") & ~(F.col("label").isin(OVERALL_LABELS) & specific))
    place = F.row_number().over(Window.partitionBy("review_id", "side", "kept").orderBy(*order))
    rows = rows.withColumn("place", place).withColumn("kept", F.col("kept") & (F.col("place") <= config.per_side))

    labels = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", "label")))), lambda x: x["label"])
    on = lambda s: F.col("side") == s
    return rows.groupBy("review_id").agg(
        labels(F.col("kept") & on("detractor")).alias("dets"), labels(F.col("kept") & on("delighter")).alias("dels"),
        F.array_sort(F.collect_list(F.when(F.col("kept") & some, F.struct("side", "label", "evidence")))).alias("evidence"),
        *[F.array_sort(F.collect_list(F.when(when & on(s), F.col("label")))).alias(f"{name}_{short}") for name, when in (("added", F.col("kept") & ~F.col("selected")), ("removed", ~F.col("kept") & F.col("selected"))) for s, short in (("detractor", "dets"), ("delighter", "dels"))],
    )


def supported_evidence(tags: DataFrame, catalog: list[tuple[str, str, list[str]]], concepts: dict = CONCEPTS) -> DataFrame:
    """tags (side, label, evidence) with supported: whether the evidence is about the label. Distinct pairs are judged once; labels outside the catalog are not supported."""
    entries = {(e.label, e.side): e for e in prepare_catalog(catalog, concepts)}

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(supported=[bool((e := entries.get((label, side))) and evidence_supports(e, text or "")) for side, label, text in f.itertuples(index=False)])

    pairs = tags.select("side", "label", "evidence").distinct().mapInPandas(judge, "side string, label string, evidence string, supported boolean")
    renamed = pairs.select(F.col("side").alias("_s"), F.col("label").alias("_l"), F.col("evidence").alias("_e"), "supported")
    return tags.join(renamed, tags["side"].eqNullSafe(F.col("_s")) & tags["label"].eqNullSafe(F.col("_l")) & tags["evidence"].eqNullSafe(F.col("_e"))).drop("_s", "_l", "_e")
