"""Betweenness from many sources at once: path counts of all sources as packed blocks of numbers.

Nodes are numbered densely, sources are dealt into chunks of ``LANES``. A strip of ``STRIP`` nodes and a chunk have
one row per level with the values other than 0, as places (node in the strip times ``LANES`` plus source) and
numbers. An edge is shipped once per chunk and level as a few bytes, and never becomes a row per source.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.operators.ranking import ordinal_rank
from ledgersignal.operators.skew import lookup_by_key
from ledgersignal.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the jobs
LANES = 32  # Sources of a chunk.
STRIP = 8192  # Nodes that are added up in one group.
BLOCK = 8 * STRIP  # Senders of one group; a sender's place fits two bytes.
PIECE_EDGES = 1 << 22  # Edges of one group, about: pieces of a block are dealt by receiver.
SLICE = 1 << 14  # Edges whose values are gathered at a time.
PACKED = "strip long, chunk long, at binary, value binary"
KEY = ["strip", "chunk"]


def _row(strip: int, chunk: int, at: np.ndarray, value: np.ndarray, **more) -> dict:
    return {"strip": strip, "chunk": chunk, "at": at.astype(np.int32).tobytes(), "value": value.tobytes()} | more


def _total(rows: pd.DataFrame) -> np.ndarray:
    """What has arrived in a strip, over all rows."""
    total = np.zeros(STRIP * LANES)
    for at, value in zip(rows["at"], rows["value"], strict=True):
        total[np.frombuffer(at, np.int32)] += np.frombuffer(value)
    return total


def _piece(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """The edges of a piece, ordered by receiver."""
    edges = edges.sort_values("dst")
    src, dst = (edges["src"] % BLOCK).to_numpy(np.uint16), edges["dst"].to_numpy(np.int64)
    return pd.DataFrame([{"block": key[0], "piece": key[1], "src": src.tobytes(), "dst": dst.tobytes()}])


def _send(key: tuple, state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Sums of a block's values over the edges of one piece, a row per strip of receivers."""
    chunk, out = key[1], []
    values = np.zeros((BLOCK, LANES))
    for strip, at, value in zip(state["strip"], state["at"], state["value"], strict=True):
        values.reshape(-1)[strip * STRIP % BLOCK * LANES + np.frombuffer(at, np.int32)] = np.frombuffer(value)
    busy = values.any(axis=1)
    for src, dst in zip(edges["src"], edges["dst"], strict=True):
        src, dst = np.frombuffer(src, np.uint16), np.frombuffer(dst, np.int64)
        used = busy[src]
        src, dst = src[used], dst[used]
        starts = np.flatnonzero(np.diff(dst // STRIP, prepend=-1))
        for low, high in zip(starts, np.append(starts, len(dst))[1:], strict=True):
            got = np.zeros((STRIP, LANES))
            for i in range(low, high, SLICE):
                to = dst[i : min(i + SLICE, high)] % STRIP
                firsts = np.flatnonzero(np.diff(to, prepend=-1))
                got[to[firsts]] += np.add.reduceat(values[src[i : i + len(to)]], firsts, axis=0)
            flat = got.reshape(-1)
            at = np.flatnonzero(flat)
            out.append(_row(dst[low] // STRIP, chunk, at, flat[at]))
    return pd.DataFrame(out, columns=["strip", "chunk", "at", "value"])


def _reach(key: tuple, arrived: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """The next level of a strip: path counts where none had been, and the places seen so far."""
    total = _total(arrived)
    old = np.frombuffer(seen["seen"].iloc[0], np.uint8) if len(seen) else np.zeros(STRIP * LANES // 8, np.uint8)
    total[np.unpackbits(old).astype(bool)] = 0
    at = np.flatnonzero(total)
    return pd.DataFrame([_row(*key, at, total[at], n=len(at), seen=(np.packbits(total > 0) | old).tobytes())])


def _depend(key: tuple, arrived: pd.DataFrame, level: pd.DataFrame) -> pd.DataFrame:
    """Dependencies of a strip's nodes at one level: what they send on, and their sums over the chunk's sources."""
    total, out = _total(arrived), []
    for at, value in zip(level["at"], level["value"], strict=True):
        at, sigma = np.frombuffer(at, np.int32), np.frombuffer(value)
        delta = sigma * total[at]
        sums = np.bincount(at // LANES, weights=delta)
        nodes = np.unique(at // LANES)
        out.append(_row(*key, at, (1 + delta) / sigma, nodes=nodes, sums=sums[nodes]))
    return pd.DataFrame(out, columns=["strip", "chunk", "at", "value", "nodes", "sums"])


def _together(left: DataFrame, right: DataFrame, key: list[str], function, schema: str) -> DataFrame:
    """Cogroup by key; the columns are named anew, as both sides may come from the same table."""
    return left.toDF(*left.columns).groupBy(*key).cogroup(right.toDF(*right.columns).groupBy(*key)).applyInPandas(function, schema)


class Pieces:
    """A numbered adjacency cut into pieces: by block of senders, and by receiver within it."""

    def __init__(self, edges: DataFrame):
        keyed = edges.withColumn("block", F.floor(F.col("src") / BLOCK))
        counts = keyed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PIECE_EDGES).alias("pieces"))
        dealt = keyed.join(F.broadcast(counts), "block").withColumn("piece", F.pmod(F.xxhash64("dst"), F.col("pieces")))
        grouped = dealt.select("block", "piece", "src", "dst").groupBy("block", "piece")
        self.table = cut_lineage(grouped.applyInPandas(_piece, "block long, piece long, src binary, dst binary"))

    def send(self, state: DataFrame) -> DataFrame:
        """Sums of the state over all edges, in parts: a strip and chunk may have several rows."""
        state = state.select("strip", "chunk", "at", "value", F.floor(F.col("strip") * STRIP / BLOCK).alias("block"))
        senders = state.join(self.table.select("block", "piece"), "block")
        edges = self.table.join(state.select("block", "chunk").distinct(), "block")
        return _together(senders, edges, ["block", "chunk", "piece"], _send, PACKED)


def betweenness(adjacency: DataFrame, k: int, seed: int, **hot) -> DataFrame:
    """(node, betweenness) over an ``undirected`` adjacency, from the k first nodes in the order of a seeded hash."""
    adjacency = cut_lineage(adjacency.select("src", "dst"))
    ranked = ordinal_rank(adjacency.select(F.col("src").alias("node")).distinct(), ["node"], "_i")
    degrees = adjacency.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    nodes = cut_lineage(ranked.withColumn("_i", F.col("_i") - 1).join(degrees, "node"))
    n = nodes.count()
    numbers = [nodes.select(F.col("node").alias(end), F.col("_i").alias(f"_{end}"), "n") for end in ("src", "dst")]
    edges = lookup_by_key(lookup_by_key(adjacency, numbers[0], "src", **hot), numbers[1], "dst", **hot)
    pieces = Pieces(edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")))
    sources = ordinal_rank(cut_lineage(nodes.orderBy(order, "node").limit(k).select("_i")), ["_i"], "_s")
    lane, chunk = (F.col("_s") - 1) % LANES, F.floor((F.col("_s") - 1) / LANES).alias("chunk")
    start = sources.select(F.floor(F.col("_i") / STRIP).alias("strip"), chunk, (F.col("_i") % STRIP * LANES + lane).alias("place"))

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(STRIP * LANES)
        total[rows["place"]] = 1.0
        at = np.flatnonzero(total)
        return pd.DataFrame([_row(*key, at, total[at], n=len(at), seen=np.packbits(total > 0).tobytes())])

    reach = f"{PACKED}, n long, seen binary"
    reached = cut_lineage(start.groupBy(*KEY).applyInPandas(first, reach))
    used, done, levels = min(k, n), 0, []
    while found := reached.agg(F.sum("n")).first()[0]:
        levels.append(reached.filter("n > 0").select("strip", "chunk", "at", "value"))
        done += found
        if done == used * n:  # every source has reached every node
            break
        arrived = pieces.send(levels[-1])
        reached = cut_lineage(_together(arrived, reached.select(*KEY, "seen"), KEY, _reach, reach))

    scored, arrived = None, None
    for level in reversed(levels[1:]):  # a source gets nothing from its own paths
        if arrived is None:
            arrived = level.limit(0)
        state = cut_lineage(_together(arrived, level, KEY, _depend, f"{PACKED}, nodes array<long>, sums array<double>"))
        both = state.select("strip", F.explode(F.arrays_zip("nodes", "sums")).alias("_e"))
        part = both.select((F.col("strip") * STRIP + F.col("_e.nodes")).alias("_i"), F.col("_e.sums").alias("delta"))
        scored = part if scored is None else scored.unionByName(part)
        arrived = pieces.send(state)
    if scored is None:
        return cut_lineage(nodes.select("node", F.lit(0.0).alias("betweenness")))
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = scored.groupBy("_i").agg((F.sum("delta") * scale).alias("betweenness"))
    return cut_lineage(nodes.join(sums, "_i", "left").select("node", "betweenness").fillna(0.0, subset=["betweenness"]))
