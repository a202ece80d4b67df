"""Labels that may be alike, what hangs together, and many phrases at once: against all pairs, plain union and plain search."""

import random

from tallyvox.functions import phrases
from tallyvox.functions.wording import likeness, overlap, plain, stems
from tallyvox.operators import audit, evidence, links, taxonomy


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(2)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "y"), ("a", None)] + [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(45)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert links.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_no_alike_pair_is_lost(spark):
    rng = random.Random(4)
    words = ["loud", "louder", "noise", "noisy", "motor", "battery", "batteries", "clean", "cleaning", "easy", "a", "aaa", "anana", "ananas", "banana", "no", "x"]
    labels = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))).title() for _ in range(160)}
    labels |= {x[:-1] for x in list(labels)[:40] if len(x) > 2} | {x[:3] + "q" + x[4:] for x in list(labels)[:40] if len(x) > 5} | {"!", "", "A", "B"}
    rows = spark.createDataFrame([("detractor", "T", x, i % 5) for i, x in enumerate(sorted(labels))] + [("delighter", "T", "Loud", 1), ("delighter", "U", "Louder", 1)], "side string, theme string, label string, review_hits int")
    want = set()
    for a in labels:
        for b in labels:
            x, y = plain(a), plain(b)
            if a < b and x and y and (likeness(x, y) >= 0.84 or likeness(y, x) >= 0.84 or x in y or y in x):
                want.add((a, b))
    found = links.alike_candidates(rows, ["side", "theme"], "label", 0.84).where("side = 'detractor'").collect()
    got = {(r["label_a"], r["label_b"]) for r in found}
    assert want <= got and len(got) < len(labels) ** 2 / 4
    merges = {frozenset((r["keep"], r["merge"])) for r in taxonomy.suggest_merges(rows, 100_000).where("side = 'detractor'").collect()}
    alike = {frozenset((a, b)) for a in labels for b in labels if a < b and plain(a) and plain(b) and (likeness(plain(a), plain(b)) >= 0.84 or overlap(stems(a), stems(b)) >= 0.75 or plain(a) in plain(b) or plain(b) in plain(a))}
    assert merges == alike


def test_merged_labels_end_in_one(spark):
    """A chain of three: all end in the most frequent, whatever the order."""
    names = [("Loud Motor Noise", 3), ("Motor Noise Hum", 9), ("Noise Hum Tone", 4), ("Zebra", 5)]
    rows = spark.createDataFrame([(f"{label}{i}", "detractor", label) for label, n in names for i in range(n)], "key string, side string, label string")
    got = {r["label"]: r["merged_into"] for r in audit.merged_candidates(audit.candidate_labels(rows)).collect()}
    assert got == {"Loud Motor Noise": "Motor Noise Hum", "Motor Noise Hum": None, "Noise Hum Tone": "Motor Noise Hum", "Zebra": None}


def test_many_phrases_at_once(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["cleaning", "cleans", "clean", "battery"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    catalog = [(said(rng.randint(1, 3)).title(), rng.choice(["detractor", "delighter"]), [said(2) for _ in range(rng.randint(0, 3))]) for _ in range(1000)] + [("Battery", "detractor", None), ("", "detractor", ["w"])]
    texts = [said(rng.randint(1, 60)).capitalize() + "." for _ in range(60)] + [None, "", " \n", "Batterys"]
    entries = [phrases.label_entry(label, a) for label, _, a in catalog]
    want = []
    for p, own in entries:
        hits = by_phrase = 0
        for t in texts:
            t = plain(t)
            if not t:
                continue
            yes = any(x in t if " " in x else len(x) >= 5 and f" {x} " in f" {t} " for x in p)
            share = own and len(set(own) & {phrases._stem(w) for w in t.split()}) >= 0.8 * len(own)
            hits, by_phrase = hits + bool(yes or share), by_phrase + yes
        want.append((hits, by_phrase))
    rows = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "review_id string, review_text string, at int").repartition(3)
    got = {r["position"]: r for r in taxonomy.label_support(rows, catalog).collect()}
    assert [got[i]["review_hits"] for i in range(len(catalog))] == [h for h, _ in want]
    assert all(len(r["examples"]) == min(3, r["review_hits"]) for r in got.values())
    pack = evidence.supported_pack(rows, catalog, max_per_side=10_000)
    squeezed = [" ".join((t or "").lower().split()) for t in texts]
    own = [dict.fromkeys(" ".join(x.lower().split()) for x in (label, *(a or []))) for label, _, a in catalog[:-1]]
    expect = {i: n for i, p in enumerate(own) if (n := sum(any(x and x in t for x in p) for t in squeezed))}
    assert {r["position"]: r["hits"] for r in pack.where("position < 1001").collect()} == expect
