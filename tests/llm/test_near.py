"""Near copies at the rule of the pipeline's near stage."""

import random

import pytest

import corpus_pipeline
from pathloom.llm import jaccard

SCHEMA = "doc_id long, text string, lang string"


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def planted(seed=7, n=60):
    """(original, copy) with words replaced at random places, at similarities of 0.8 and more, and some below 0.7."""
    rng = random.Random(seed)
    near, far = [], []
    while len(near) < n or len(far) < 20:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 300, 1000]))]
        copy = list(words)
        for k in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.1])))):
            copy[k] = f"x{rng.randrange(5000)}"
        a, b = " ".join(words), " ".join(copy)
        s = similarity(a, b)
        if s >= 0.8 and len(near) < n:
            near.append((a, b))
        elif s < 0.7 and len(far) < 20:
            far.append((a, b))
    return near, far


@pytest.mark.parametrize(("block", "pivots"), [(1024, 16), (1, 16), (1, 0), (1, 1)])
def test_near_stage_finds_all_planted_copies_and_no_others(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    near, far = planted()
    rows = [(2 * k + e, t, "en") for k, pair in enumerate(near + far) for e, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = jaccard.dedup(docs, block=block) if block == 1 else corpus_pipeline.near_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([2 * k for k in range(len(near))] + list(range(2 * len(near), len(rows))))


def test_joined_equals_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(5, 9))) for _ in range(120)]
    groups = jaccard.sets([t.encode() for t in texts])
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    got = list(range(len(texts)))
    for member, top in jaccard.joined(groups):
        got[member] = top
    assert got == root


def test_null_and_reused_ids_lose_no_text(spark):
    a, b, c = ("one clean text about rivers and hills", "another text on bread and a long winter", "a third text of machines and glass")
    docs = spark.createDataFrame([(None, a, None), (None, b, None), (5, c, None), (5, a + " x y z u v w", None), (None, c, None)], SCHEMA)
    assert sorted(map(tuple, jaccard.dedup(docs).select("doc_id", "text").collect()), key=str) == sorted([(None, a), (None, b), (5, c), (5, a + " x y z u v w")], key=str)


def test_a_hot_group_of_several_blocks_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for k in rng.sample(range(200), 2):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.sample(base, 100)) for _ in range(5)]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted(r["doc_id"] for r in jaccard.dedup(docs, block=10).collect())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert got == sorted(set(root))


def test_fingerprints_within_the_radius_are_candidates(spark):
    reps = spark.createDataFrame([(5, [1], 0), (7, [2], 15), (9, [3], 0), (11, [4], -1)], "sid long, bands array<long>, fp long")
    edges = [(r["u"], r["v"]) for r in jaccard.candidates(reps).collect()]
    from pathloom.llm import components

    assert components.forest(iter(edges)) == {7: 5, 9: 5}
