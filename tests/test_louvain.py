"""Modularity communities against a plain program of local moves."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from ledgersignal.operators import louvain as LV


def groups(seed, sizes, inside, outside):
    rng = random.Random(seed)
    of = [g for g, n in enumerate(sizes) for _ in range(n)]
    return [(a, b, rng.randint(1, 3)) for a in range(len(of)) for b in range(a) if rng.random() < (inside if of[a] == of[b] else outside)]


GRAPHS = {
    "blocks": groups(1, [5, 6, 4], 0.8, 0.05),
    "two edges": [(1, 2, 1), (3, 4, 5), (9, 9, 2)],
}


def score(rows, label, resolution=1.0):
    total = sum(2 * w for a, b, w in rows if a != b)
    k, inside = defaultdict(int), defaultdict(int)
    for a, b, w in rows:
        if a != b:
            k[label[a]] += w
            k[label[b]] += w
            inside[label[a]] += 2 * w * (label[a] == label[b])
    return sum(inside[c] / total - resolution * (k[c] / total) ** 2 for c in k)


def local_moves(rows, resolution):
    """One node after the other goes where modularity is largest, until none moves."""
    nodes = sorted({n for a, b, _ in rows if a != b for n in (a, b)})
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for n in nodes:
            options = {label[m] for a, b, _ in rows if n in (a, b) for m in (a, b)}
            best = max(options, key=lambda c: (round(score(rows, {**label, n: c}, resolution), 12), -c))
            if score(rows, {**label, n: best}, resolution) > score(rows, label, resolution) + 1e-9:
                label[n], moved = best, True
    return score(rows, label, resolution)


def run(spark, rows, **settings):
    edges = spark.createDataFrame([(a, b, float(w), w) for a, b, w in rows], "src long, dst long, total_volume double, txn_count long")
    found = LV.modularity_communities(edges, **settings).collect()
    label = {r.node: r.community_id for r in found}
    assert len(label) == len(found) and set(label) == {n for a, b, _ in rows if a != b for n in (a, b)}
    for r in found:
        assert r.community_id == min(n for n in label if label[n] == r.community_id) and r.community_size == list(label.values()).count(r.community_id)
    return label


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_modularity(spark, name):
    rows = GRAPHS[name]
    assert score(rows, run(spark, rows)) >= local_moves(rows, 1.0) - 1e-9


def test_no_edges(spark):
    assert LV.modularity_communities(spark.createDataFrame([], "src long, dst long, total_volume double, txn_count long")).collect() == []
