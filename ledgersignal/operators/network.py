"""Network features as joins and aggregates over edge tables.

Iterative operators keep the adjacency partitioned by source between rounds, so that only the small
per-node state moves. Edges of hub nodes are held apart: their per-node state is at most
``MAX_HOT_KEYS`` rows and is broadcast to them (or joined by salt where a node has several state
rows). State is checkpointed between rounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.functions.scalars import cents
from ledgersignal.operators.betweenness import betweenness
from ledgersignal.operators.ranking import ordinal_rank
from ledgersignal.operators.skew import MAX_HOT_KEYS, MIN_HOT_ROWS, fetch_hot, lookup_by_key, salted_join
from ledgersignal.operators.triangles import CELL_EDGES, triangle_counts
from ledgersignal.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tiles' functions travel with the jobs
A = "account_id"
BLOCK = 8192  # Accounts per block of shared networks: a place and a flag fit two bytes, a bitmap has 1 kB.
TILE_DST, TILE_PAIRS = 2048, 32768  # Bitmaps held and combined at a time.
BIT_COUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def build_edges(txn: DataFrame, signed: bool = False) -> DataFrame:
    """Account-counterparty edges with volume and count; ``signed`` nets credits against debits."""
    amount = F.when(F.col("amount") < 0, -cents(F.abs("amount"))).otherwise(cents("amount")) if signed else cents(F.abs("amount"))
    return (
        txn.filter(F.col(A).isNotNull() & F.col("counterparty_id").isNotNull())
        .groupBy(F.col(A).alias("src"), F.col("counterparty_id").alias("dst"))
        .agg((F.sum(amount) / 100).alias("total_volume"), F.count(F.lit(1)).alias("txn_count"))
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge without self loops; parallel edges are added up.

    A node that has only a self loop is no part of the result; operators that count all nodes add it.
    """
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum("txn_count").alias("w"))
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("_e"), "w").select("_e.src", "_e.dst", "w")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("degree"))


class Neighbourhood:
    """A fixed adjacency prepared for repeated joins with per-node state."""

    def __init__(self, adjacency: DataFrame, min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT_KEYS):
        adjacency = cut_lineage(adjacency)
        self.adjacency = adjacency
        self.hubs = fetch_hot(adjacency.groupBy("src").agg(F.count(F.lit(1)).alias("n")), ["src"], "n", min_rows, max_hot)
        cold = adjacency if self.hubs is None else adjacency.join(F.broadcast(self.hubs), "src", "left_anti")
        self.cold = cold.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        self.hot = None if self.hubs is None else adjacency.join(F.broadcast(self.hubs), "src", "left_semi")

    def join(self, state: DataFrame, one_row: bool = True) -> DataFrame:
        """Edges with the state columns of their source (``state.node`` = ``src``).

        ``one_row`` says that a node has one state row, so that the state of the hubs is small.
        """
        keyed = state.withColumnRenamed("node", "src")
        out = self.cold.join(keyed, "src")
        if self.hubs is None:
            return out
        of_hubs = keyed.join(F.broadcast(self.hubs), "src", "left_semi")
        joined = self.hot.join(F.broadcast(of_hubs), "src") if one_row else salted_join(self.hot, of_hubs, ["src"])
        return out.unionByName(joined)

    def nodes(self) -> DataFrame:
        return self.adjacency.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))

    def finish(self, result: DataFrame) -> DataFrame:
        done = cut_lineage(result)
        self.cold.unpersist()
        return done


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 500, tol: float | None = 1e-4, cut_every: int = 5, **hot) -> DataFrame:
    """Weighted PageRank on the undirected graph; stops when the L1 change is below n * tol.

    Self loops count once in a node's strength, so a node with nothing else keeps its share. Ranks that have
    not settled after ``max_iter`` rounds are an error; ``tol=None`` asks for exactly ``max_iter`` rounds.
    """
    loops = edges.filter(F.col("src") == F.col("dst")).groupBy("src", "dst").agg(F.sum("txn_count").alias("w"))
    graph = Neighbourhood(undirected(edges).unionByName(loops), **hot)
    nodes = cut_lineage(graph.nodes())
    n = nodes.count()
    ranks = nodes.select("node", "strength", F.lit(1.0 / n).alias("rank"))
    for i in range(1, max_iter + 1):
        sent = graph.join(ranks.select("node", (F.col("rank") / F.col("strength")).alias("share")))
        received = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("w")).alias("got"))
        new = nodes.join(received, "node", "left").select("node", "strength", (F.lit((1 - alpha) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tol is None:
            ranks = cut_lineage(new) if i % cut_every == 0 else new
            continue
        new = cut_lineage(new)
        old = ranks.select("node", F.col("rank").alias("_old"))
        change = new.join(old, "node").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        ranks = new
        if change < n * tol:
            break
    else:
        if tol is not None:
            graph.cold.unpersist()
            raise RuntimeError(f"ranks still change after {max_iter} rounds; raise max_iter or tol, or pass tol=None for fixed rounds")
    return graph.finish(ranks.select("node", F.col("rank").alias("pagerank")))


def clustering(edges: DataFrame, cell_edges: int = CELL_EDGES, **hot) -> DataFrame:
    """Local clustering coefficient: (node, degree, triangles, clustering).

    Triangles are counted in cells of three colours (see ``triangles``), so the shuffled rows are edges times
    colours, the root of 6 * edges / ``cell_edges``, and no list or wedge of a node is shipped.
    """
    pairs = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    deg = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    out = deg.join(triangle_counts(pairs, deg, cell_edges, **hot), "node", "left").fillna(0, subset=["triangles"])
    d = F.col("degree")
    return out.withColumn("clustering", F.when(d >= 2, 2 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)))


def ego_density(clustered: DataFrame) -> DataFrame:
    """Density among a node's neighbours; equal to the clustering coefficient on a simple graph."""
    return clustered.select("node", F.col("clustering").alias("ego_density"))


def connected_components(edges: DataFrame, **hot) -> DataFrame:
    """Smallest reachable id as component, and its size. Runs until nothing changes.

    Each round takes the smallest label among neighbours, then replaces labels by the label of their
    label, which shortens long chains quickly. Giant components make label values hot, so the
    second step joins through a per-label table.
    """
    graph = Neighbourhood(undirected(edges), **hot)
    alone = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    labels = cut_lineage(graph.nodes().select("node").unionByName(alone).distinct().select("node", F.col("node").alias("component")))
    while True:
        offered = graph.join(labels).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("_m"))
        hooked = cut_lineage(labels.join(offered, "node", "left").select("node", F.least("component", "_m").alias("new"), F.col("component").alias("old")))
        sizes = hooked.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        target = hooked.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = lookup_by_key(hooked, sizes.join(target, "new"), "new", **hot)
        labels = cut_lineage(jumped.select("node", "old", F.least("new", "jump").alias("component")))
        changed = not labels.filter(F.col("component") != F.col("old")).isEmpty()
        labels = labels.select("node", "component")
        if not changed:
            break
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return graph.finish(lookup_by_key(labels, sizes.withColumn("component_size", F.col("n")), "component", **hot))


def communities(edges: DataFrame, rounds: int | None = None, most: int = 100, **hot) -> DataFrame:
    """Label-propagation communities: heaviest neighbouring label, then the smallest one.

    Runs until no label changes; if that takes more than ``most`` rounds, it fails instead of returning labels
    that still move. ``rounds`` asks for a fixed number of rounds.

    All nodes change at once; each also votes for its own label with its total weight halved, which
    stops two-coloured parts from swapping labels forever.
    """
    graph = Neighbourhood(undirected(edges), **hot)
    nodes = cut_lineage(graph.nodes())
    labels = nodes.select("node", F.col("node").alias("label"))
    own = nodes.select("node", F.floor(F.col("strength") / 2).alias("_own"))
    for _ in range(most if rounds is None else rounds):
        votes = graph.join(labels).select(F.col("dst").alias("node"), "label", "w").unionByName(labels.join(own, "node").select("node", "label", F.col("_own").alias("w")))
        tally = votes.groupBy("node", "label").agg(F.sum("w").alias("w"))
        new = cut_lineage(tally.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")))
        same = rounds is None and new.join(labels.withColumnRenamed("label", "_old"), "node").filter(F.col("label") != F.col("_old")).isEmpty()
        labels = new
        if same:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"labels still change after {most} rounds")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = lookup_by_key(labels, sizes.withColumn("community_size", F.col("n")), "label", **hot)
    return graph.finish(out.withColumnRenamed("label", "community_id"))


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Weighted modularity of a (node, community_id) assignment as one row."""
    adj = undirected(edges)
    label = lambda side: community.select(F.col("node").alias(side), F.col("community_id").alias(f"_{side}"))
    joined = adj.join(label("src"), "src").join(label("dst"), "dst")
    per = joined.groupBy(F.col("_src").alias("c")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("w")).otherwise(0)).alias("inside"))
    total = adj.agg(F.sum("w")).scalar()
    share = per.withColumn("m2", total)
    return share.agg(F.sum(F.col("inside") / F.col("m2") - (F.col("k") / F.col("m2")) * (F.col("k") / F.col("m2"))).alias("modularity"))


def betweenness_sampled(edges: DataFrame, k: int = 500, seed: int = 42, **hot) -> DataFrame:
    """Betweenness from k sources in hash order, for all sources in the same passes over the edges.

    Breadth-first levels are followed until every node is reached or no frontier is left; dependencies flow back
    level by level.
    """
    return betweenness(undirected(edges), k, seed, **hot)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def mule_overlap(edges: DataFrame, labels: DataFrame, **hot) -> DataFrame:
    """Counterparties that known mules also use: count and share per account."""
    mules = labels.filter(F.col("is_mule") == 1).select(F.col(A).alias("src"), F.lit(1).alias("_mule"))
    pairs = _pairs(edges).join(mules, "src", "left")
    cps = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("_mule", F.lit(0))).alias("_used"))
    joined = lookup_by_key(pairs.select("src", "dst"), cps, "dst", **hot)
    hits = F.sum("_used")
    return joined.groupBy(F.col("src").alias(A)).agg(hits.alias("cp_mule_overlap"), (hits / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("cp_mule_overlap_ratio"))


def _unions(at: np.ndarray, sources: np.ndarray, dst: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Bits of all members that share a counterparty with each source of a block.

    ``at``/``sources`` and ``dst``/``members`` are (counterparty, place in the block) pairs. Bitmaps are made for a
    few thousand counterparties and combined for a slice of pairs at a time, so memory does not grow with either.
    """
    found = np.zeros((BLOCK, BLOCK // 8), np.uint8)
    order = np.argsort(at, kind="stable")
    at, sources = at[order], sources[order]
    order = np.argsort(dst, kind="stable")
    dst, members = dst[order], members[order]
    for low in range(0, int(at[-1]) + 1, TILE_DST):
        own = slice(*np.searchsorted(dst, [low, low + TILE_DST]))
        bits = np.zeros((TILE_DST, BLOCK), np.uint8)
        bits[dst[own] - low, members[own]] = 1
        maps = np.packbits(bits, axis=1)
        theirs = slice(*np.searchsorted(at, [low, low + TILE_DST]))
        by_source = np.argsort(sources[theirs], kind="stable")
        rows, place = at[theirs][by_source] - low, sources[theirs][by_source]
        for i in range(0, len(rows), TILE_PAIRS):
            here = place[i : i + TILE_PAIRS]
            starts = np.flatnonzero(np.diff(here, prepend=-1))
            found[here[starts]] |= np.bitwise_or.reduceat(maps[rows[i : i + TILE_PAIRS]].view(np.uint64), starts, axis=0).view(np.uint8)
    return found


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of accounts: per account of either, how many of the other block share a counterparty, and how many mules."""
    a, b = key
    lengths = rows["codes"].str.len().to_numpy()
    dst = np.repeat(np.unique(rows["dst"].to_numpy(), return_inverse=True)[1], lengths)
    side = np.repeat(rows["block"].to_numpy(), lengths)
    codes = np.concatenate(rows["codes"].to_numpy()).astype(np.int64)
    place, mule = codes >> 1, (codes & 1).astype(bool)
    parts = []
    for one, other in {(a, b), (b, a)}:
        of, to = side == one, side == other
        found = _unions(dst[of], place[of], dst[to], place[to])
        mules = np.zeros(BLOCK, np.uint8)
        mules[place[to & mule]] = 1
        seen = np.unique(place[of])
        bits = found[seen]
        parts.append(pd.DataFrame({"_i": one * BLOCK + seen, "_all": BIT_COUNT[bits].sum(axis=1), "_mules": BIT_COUNT[bits & np.packbits(mules)].sum(axis=1)}))
    return pd.concat(parts)


def _union_sizes(pairs: DataFrame, accounts: DataFrame, hot: dict) -> DataFrame:
    """Per account the number of distinct accounts, and of mules among them, seen over all its counterparties.

    Accounts are numbered densely and dealt into blocks; a counterparty's accounts of one block are one short list.
    Two blocks meet in a tile with the lists of the counterparties that both use, where bitmaps are combined. What
    is shipped is two bytes per edge and block that shares the counterparty, never a bitmap or an account-account
    pair.
    """
    numbered = cut_lineage(ordinal_rank(accounts, ["src"], "_i").withColumn("_i", F.col("_i") - 1))
    code = (2 * (F.col("_i") % BLOCK) + F.col("_mule")).cast("smallint")
    placed = pairs.filter(F.col("dst").isNotNull()).join(numbered, "src").select("dst", F.floor(F.col("_i") / BLOCK).alias("block"), code.alias("code"))
    lists = cut_lineage(placed.groupBy("dst", "block").agg(F.collect_list("code").alias("codes")))
    users = lists.groupBy("dst").agg(F.collect_list("block").alias("blocks"), F.count(F.lit(1)).alias("n"))
    met = lookup_by_key(lists, users, "dst", how="inner", **hot).select("dst", "block", "codes", F.explode("blocks").alias("other"))
    tiles = met.select("dst", "block", "codes", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    sizes = tiles.groupBy("a", "b").applyInPandas(_tile, "_i bigint, _all bigint, _mules bigint")
    return sizes.groupBy("_i").agg(F.sum("_all").alias("_all"), F.sum("_mules").alias("_mules")).join(numbered.select("src", "_i"), "_i").drop("_i")


def shared_network(edges: DataFrame, labels: DataFrame, **hot) -> DataFrame:
    """Distinct other accounts that share a counterparty, and how many of them are known mules."""
    pairs = cut_lineage(_pairs(edges))
    mules = labels.filter(F.col("is_mule") == 1).select(F.col(A).alias("src"), F.lit(1).alias("_own"))
    accounts = pairs.select("src").distinct().join(mules.distinct(), "src", "left").select("src", F.coalesce("_own", F.lit(0)).alias("_mule"))
    joined = _union_sizes(pairs, accounts, hot).join(mules, "src", "left").fillna(0, subset=["_own"])
    return joined.select(F.col("src").alias(A), (F.col("_all") - 1).alias("shared_network_size"), (F.col("_mules") - F.col("_own")).alias("shared_mule_neighbors"))


def _counterparty_table(edges: DataFrame, accounts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per counterparty: how many edges end there, whether it is an account, whether it is a mule."""
    ids = accounts.select(F.col(A).alias("dst"), F.lit(1).alias("_internal"))
    mules = labels.filter(F.col("is_mule") == 1).select(F.col(A).alias("dst"), F.lit(1).alias("_mule"))
    fan = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return fan.join(ids, "dst", "left").join(mules, "dst", "left").fillna(0, subset=["_internal", "_mule"])


def mule_exposure(edges: DataFrame, labels: DataFrame, accounts: DataFrame, **hot) -> DataFrame:
    """Counterparties that are mules (count, share, volume share) or accounts of the bank."""
    joined = lookup_by_key(edges, _counterparty_table(edges, accounts, labels), "dst", **hot)
    mule = F.col("_mule") == 1
    n, v = F.count(F.lit(1)), F.sum(cents("total_volume"))
    hit = F.coalesce(F.sum(F.when(mule, cents("total_volume"))), F.lit(0))
    return joined.groupBy(F.col("src").alias(A)).agg(
        F.sum("_mule").alias("cp_mule_count"),
        (F.sum("_mule") / F.greatest(n, F.lit(1))).alias("cp_mule_rate"),
        (hit / F.greatest(v, F.lit(100))).alias("cp_mule_vol_pct"),
        n.alias("cp_unique_count_graph"),
        F.sum("_internal").alias("cp_internal_count"),
    )


def two_hop_exposure(edges: DataFrame, labels: DataFrame, **hot) -> DataFrame:
    """Mule counterparties of an account's mule counterparties, added up per account."""
    mules = labels.filter(F.col("is_mule") == 1)
    pairs = _pairs(edges)
    fan = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    mule_dst = fan.join(mules.select(F.col(A).alias("dst"), F.lit(1).alias("_mule")), "dst", "left").fillna(0, subset=["_mule"])
    marked = lookup_by_key(pairs, mule_dst, "dst", **hot)
    own = marked.groupBy(F.col("src").alias("dst")).agg(F.sum("_mule").alias("_theirs"))
    second = mule_dst.filter(F.col("_mule") == 1).drop("_mule").join(own, "dst", "left")
    hop = lookup_by_key(pairs, second, "dst", **hot)
    return hop.groupBy(F.col("src").alias(A)).agg(F.coalesce(F.sum("_theirs"), F.lit(0)).alias("cp_2hop_mule_count"))
