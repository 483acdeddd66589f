"""Triangle counts by node triples: every edge travels a fixed number of times, whatever the wedges are.

Nodes fall into p colours by hash. A task owns one multiset of three colours and gets the edges between them, so
each edge is shipped p times, and a cell has about 6 / p**2 of all edges; p follows from the edge count and
``CELL_EDGES``. A triangle is counted in the cell of its own three colours only.

A node with more than 4 / p of all edges would crowd the cells of its colour. There are fewer than p / 2 such hubs.
Their edges stay out of the cells: every node lists the hubs it touches, and the common hubs of an edge's two ends
close its triangles. A triangle with several hubs is counted at its highest one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.operators.skew import lookup_by_key

CELL_EDGES = 1_000_000
WEDGES = 4_000_000  # wedges looked at together in a task


def colours_for(edges: int, cell_edges: int) -> int:
    """At least three colours, ten cells, so that a small graph is counted by several tasks too."""
    return max(3, math.ceil(math.sqrt(6 * edges / cell_edges)))


def cells(edges: DataFrame, p: int) -> DataFrame:
    """(cell, a, b, ca, cb): each edge once for every cell that holds both of its colours, p rows an edge."""
    colour = lambda c: F.pmod(F.xxhash64(c, F.lit("cell")), F.lit(p)).cast("int")
    coloured = edges.select("a", "b", colour("a").alias("ca"), colour("b").alias("cb"))
    third = coloured.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    of = F.sort_array(F.array("ca", "cb", "_x"))
    number = (of[0].cast("bigint") * p + of[1]) * p + of[2]
    return third.select(number.alias("cell"), "a", "b", "ca", "cb")


def _corners(n: int, edges: np.ndarray, colour: np.ndarray, cell: list[int]) -> np.ndarray:
    """Triangles per node among numbered edges, of those whose corners have just the cell's colours (ascending)."""
    degree = np.bincount(edges.ravel(), minlength=n)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((np.arange(n), degree))] = np.arange(n)
    low, high = np.sort(rank[edges], axis=1).T  # from the node of few edges to the node of many
    keys = np.sort(low * n + high)
    low, high = keys // n, keys % n
    shade = np.empty(n, dtype=np.int64)
    shade[rank] = colour
    ends = np.searchsorted(low, low, side="right")
    ahead = ends - np.arange(len(low)) - 1  # edges after this one with the same lower end
    found = np.zeros(n, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(ahead)))
    start = 0
    while start < len(low):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + WEDGES, side="right")) - 1)
        first = np.repeat(np.arange(start, stop), ahead[start:stop])
        second = first + 1 + np.arange(len(first)) - np.repeat(total[start:stop] - total[start], ahead[start:stop])
        asked = high[first] * n + high[second]
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[place] == asked
        three = np.stack([low[first[hit]], high[first[hit]], high[second[hit]]])
        own = (np.sort(shade[three], axis=0) == np.array(cell)[:, None]).all(axis=0)
        found += np.bincount(three[:, own].ravel(), minlength=n)
        start = stop
    return found[rank]


def _in_cells(edges: DataFrame, p: int) -> DataFrame:
    """(node, triangles) of each cell."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([frame["a"], frame["b"]], ignore_index=True))
        colour = np.zeros(len(names), dtype=np.int64)
        colour[codes] = np.concatenate([frame["ca"], frame["cb"]])
        cell = int(frame["cell"].iloc[0])
        found = _corners(len(names), codes.reshape(2, -1).T, colour, [cell // (p * p), cell // p % p, cell % p])
        return pd.DataFrame({"node": names[found > 0], "triangles": found[found > 0]})

    schema = f"node {edges.schema['a'].dataType.simpleString()}, triangles bigint"
    return cells(edges, p).groupBy("cell").applyInPandas(count, schema)


def _with_hubs(edges: DataFrame, hubs: DataFrame, **hot) -> DataFrame:
    """(node, triangles) of the triangles with a hub: common hubs of both ends above the ends that are hubs."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.*")
    touching = both.join(F.broadcast(hubs.select(F.col("node").alias("b"))), "b")
    lists = touching.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("hubs"))
    known = lists.join(F.broadcast(hubs.select("node", F.col("node").alias("self"))), "node", "left")
    sided = edges
    for side in ("a", "b"):
        uses = edges.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        own = known.select(F.col("node").alias(side), F.col("hubs").alias(f"{side}_hubs"), F.col("self").alias(f"{side}_self"))
        sided = lookup_by_key(sided, own, side, how="inner", counts=uses, **hot)
    top = F.greatest("a_self", "b_self")  # NULL where neither end is a hub
    third = F.filter(F.array_intersect("a_hubs", "b_hubs"), lambda h: top.isNull() | (h > top))
    closed = sided.select("a", "b", third.alias("third")).filter(F.size("third") > 0)
    one = closed.select(F.explode("third").alias("node"), F.lit(1).cast("bigint").alias("triangles"))
    ends = closed.select(F.explode(F.array("a", "b")).alias("node"), F.size("third").cast("bigint").alias("triangles"))
    return ends.unionByName(one).groupBy("node").agg(F.sum("triangles").alias("triangles"))


def triangle_counts(edges: DataFrame, degrees: DataFrame, cell_edges: int = CELL_EDGES, **hot) -> DataFrame:
    """(node, triangles) for nodes with any. ``edges`` has every pair (a, b) once, ``degrees`` (node, degree).

    Both are read several times, so they should be written tables.
    """
    total = edges.count()
    p = colours_for(total, cell_edges)
    hubs = degrees.filter(F.col("degree") > 4 * total / p).select("node")  # fewer than p / 2 rows
    if hubs.isEmpty():
        return _in_cells(edges, p).groupBy("node").agg(F.sum("triangles").alias("triangles"))
    far = lambda df, side: df.join(F.broadcast(hubs.withColumnRenamed("node", side)), side, "left_anti")
    plain = _in_cells(far(far(edges, "a"), "b"), p)
    return plain.unionByName(_with_hubs(edges, hubs, **hot)).groupBy("node").agg(F.sum("triangles").alias("triangles"))
