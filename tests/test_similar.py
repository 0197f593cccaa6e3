"""Similarity join of templates and components against plain comparison of all pairs."""

import random

import pytest

from logweir.operators.components import components
from logweir.operators.similar import clusters_similar, similar_pairs, token_sets


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    pairs = {
        "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in rng.sample(range(150), 150)],
        "random": [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(110)],
        "star": [("n999", f"n{i:03d}") for i in range(80)],
        "none": [],
        "loops": [("a", "a"), ("b", "b")],
    }[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == reach(linked, [(a, b) for a, b in pairs if a != b])


def templates(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["<*>"] * 4
    out = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(n)} | {"a b c d e f g", "a b c d e f h", "g f e d c b a", "<*>", "one <*>"}
    return [(f"id{i:04d}", p, rng.randint(1, 5)) for i, p in enumerate(sorted(out))]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.75, 1.0])
def test_against_all_pairs(spark, threshold):
    rows = templates(150, 3)
    df = spark.createDataFrame(rows, "id string, pattern string, frequency long")
    sets = {k: frozenset(p.split(" ")) for k, p, _ in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    classes = set(first.values())
    got = {(r.a, r.b): r.similarity for r in similar_pairs(token_sets(df), threshold).collect()}
    assert got == {k: v for k, v in like.items() if set(k) <= classes and v >= threshold - 1e-9}

    root = reach(list(sets), [k for k, v in like.items() if v >= threshold - 1e-9])
    want = {}
    for k, p, n in rows:
        want.setdefault(root[k], []).append((k, p, n))
    links = {}
    for (a, _), v in like.items():
        if v >= threshold - 1e-9:
            links[root[a]] = min(links.get(root[a], 1.0), v)
    expected = sorted((r, min(p for _, p, n in m if n == max(x[2] for x in m)), len(m), sum(x[2] for x in m), links.get(r, 1.0)) for r, m in want.items() if sum(x[2] for x in m) >= 2)
    assert sorted(tuple(r) for r in clusters_similar(df, threshold).collect()) == expected


def test_no_templates_and_bad_thresholds(spark):
    empty = spark.createDataFrame([], "id string, pattern string, frequency long")
    assert clusters_similar(empty).collect() == []
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            similar_pairs(token_sets(empty), bad)
