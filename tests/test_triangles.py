"""Triangles in colour cells against a plain program, with many colours and with hubs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgersignal.operators import network as NW
from ledgersignal.operators import triangles as TR


def plain(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {v: (len(o), sum(1 for x, y in itertools.combinations(o, 2) if y in near[x])) for v, o in near.items()}


def counted(spark, pairs, **args):
    kind = "string" if isinstance(next(iter(pairs))[0], str) else "long"
    edges = spark.createDataFrame([(a, b, 1.0, 1) for a, b in pairs], f"src {kind}, dst {kind}, total_volume double, txn_count long")
    return {r["node"]: (r["degree"], r["triangles"]) for r in NW.clustering(edges, **args).collect()}


def random_pairs(seed, nodes, edges, hubs=0):
    draw = random.Random(seed)
    out = {(a, b) for a, b in ((draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)) if a < b}
    return out | {(h, v) for h in range(hubs) for v in range(h + 1, nodes)}


@pytest.mark.parametrize("cell_edges", [10**6, 100, 12])
def test_equal_to_a_plain_count(spark, cell_edges):
    pairs = random_pairs(1, 40, 300)
    assert counted(spark, pairs, cell_edges=cell_edges) == plain(pairs)


@pytest.mark.parametrize("hubs,hot", [(1, {}), (3, {}), (3, {"min_rows": 20})])
def test_hubs_close_their_triangles_once(spark, hubs, hot):
    pairs = random_pairs(2, 60, 120, hubs)
    total, p = len(pairs), TR.colours_for(len(pairs), 6)
    assert sum(1 for d, _ in plain(pairs).values() if d > 4 * total / p) >= hubs  # the hub branch is taken
    assert counted(spark, pairs, cell_edges=6, **hot) == plain(pairs)


def test_names_loops_both_directions_and_empty_tables(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d")]
    assert counted(spark, pairs) == {"a": (2, 1), "b": (2, 1), "c": (3, 1), "d": (1, 0)}
    empty = spark.createDataFrame([], "src string, dst string, total_volume double, txn_count long")
    assert NW.clustering(empty).count() == 0


def test_small_batches_of_wedges(spark, monkeypatch):
    import numpy as np

    pairs = random_pairs(3, 30, 250)
    want = {v: t for v, (_, t) in plain(pairs).items()}
    monkeypatch.setattr(TR, "WEDGES", 5)
    found = TR._corners(30, np.array(sorted(pairs)), np.zeros(30, dtype=np.int64), [0, 0, 0])
    assert all(found[v] == t for v, t in want.items())


def test_shipped_rows_grow_with_edges_times_colours(spark):
    """Hub graphs of two sizes: rows are exactly edges x colours, and no cell holds more than its share."""
    for nodes in (2_000, 8_000):
        edges = spark.range(1, nodes).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("a"))
        ring = spark.range(1, nodes - 1).select((F.col("id") + 1).alias("b"), F.col("id").alias("a"))
        both = edges.unionByName(ring)
        n = both.count()
        p = TR.colours_for(n, 500)
        assert TR.cells(both, p).count() == n * p
        largest = TR.cells(ring, p).groupBy("cell").count().agg(F.max("count")).first()[0]
        assert largest <= 500
