"""Communities by multilevel modularity optimisation with a resolution.

A level moves nodes between communities as long as modularity grows, then communities become the nodes of the
next level. Nodes move at once, half of them in a round, which may lose what each move alone would win. So a
round counts only if modularity has grown by it; if not, only moves that do not touch each other are made, whose
gains add up. Modularity grows by at least ``tol`` in every round that counts and is at most 1, so this ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.operators.network import Neighbourhood, undirected
from ledgersignal.operators.ranking import attach_row
from ledgersignal.operators.skew import lookup_by_key
from ledgersignal.session import cut_lineage

TOL = 1e-7


class Level:
    """A graph with node strengths, and what a labelling of its nodes is worth."""

    def __init__(self, adjacency: DataFrame, resolution: float, **hot):
        self.graph, self.resolution = Neighbourhood(adjacency, **hot), resolution
        self.nodes = cut_lineage(self.graph.nodes().select("node", "strength"))
        self.total = float(self.nodes.agg(F.sum("strength")).first()[0])

    def around(self, labels: DataFrame) -> DataFrame:
        """(node, target, w, loop): weight from a node to each community, loops apart."""
        loop = F.col("src") == F.col("dst")
        sums = [F.sum(F.when(on, F.col("w")).otherwise(0)).alias(name) for name, on in (("w", ~loop), ("loop", loop))]
        return cut_lineage(self.graph.join(labels).groupBy(F.col("dst").alias("node"), F.col("label").alias("target")).agg(*sums))

    def sizes(self, labels: DataFrame) -> DataFrame:
        return self.nodes.join(labels, "node").groupBy("label").agg(F.sum("strength").alias("size"))

    def modularity(self, labels: DataFrame, around: DataFrame) -> float:
        inside = around.join(labels, "node").filter(F.col("target") == F.col("label")).agg(F.sum(F.col("w") + F.col("loop")).alias("inside"))
        share = F.col("size") / F.lit(self.total)
        spread = self.sizes(labels).agg(F.sum(share * share).alias("spread"))
        row = attach_row(spread, inside).first()
        return (row.inside or 0) / self.total - self.resolution * row.spread

    def moves(self, labels: DataFrame, around: DataFrame) -> DataFrame:
        """(node, label, target, gain): the best move of every node that has one; the smallest target of equal ones."""
        stays = labels.select("node", F.col("label").alias("target"), F.lit(0).cast("bigint").alias("w"))
        options = around.select("node", "target", "w").unionByName(stays).groupBy("node", "target").agg(F.sum("w").alias("w"))
        sized = options.join(self.sizes(labels).withColumnRenamed("label", "target"), "target").join(self.nodes.join(labels, "node"), "node")
        m, own = F.lit(self.total), F.col("target") == F.col("label")
        without = F.col("size") - F.when(own, F.col("strength")).otherwise(0)
        valued = sized.withColumn("value", F.col("w") / m - self.resolution * (F.col("strength") / m) * (without / m))
        best = valued.groupBy("node").agg(
            F.min_by(F.struct("target", "value"), F.struct(-F.col("value"), "target")).alias("best"),
            F.any_value("label").alias("label"),
            F.max(F.when(own, F.col("value"))).alias("now"),
        )
        gain = 2 * (F.col("best.value") - F.col("now"))
        found = best.select("node", "label", F.col("best.target").alias("target"), gain.alias("gain"))
        return cut_lineage(found.filter((F.col("target") != F.col("label")) & (F.col("gain") > TOL)))

    def optimise(self) -> tuple[DataFrame, float, float]:
        """(node, label) after all moves, and modularity before and after."""
        labels = cut_lineage(self.nodes.select("node", F.col("node").alias("label")))
        around = self.around(labels)
        before = now = self.modularity(labels, around)
        turn = 0
        while not (moves := self.moves(labels, around)).isEmpty():
            turn += 1
            half = moves.filter(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0)
            for tried in (half, _apart(moves)):
                new = _apply(labels, tried)
                reach = self.around(new)
                reached = self.modularity(new, reach)
                if reached > now + TOL:
                    labels, around, now = new, reach, reached
                    break
            else:
                break
        return self.graph.finish(labels), before, now


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two have a community in common: the best of every community they touch."""
    rank = F.struct(-F.col("gain"), "node")
    ends = moves.select("node", "gain", F.explode(F.array("label", "target")).alias("community"))
    best = ends.groupBy("community").agg(F.min_by("node", rank).alias("node"))
    wins = best.groupBy("node").agg(F.count(F.lit(1)).alias("_won")).filter("_won = 2").select("node")
    return moves.join(wins, "node", "left_semi")


def _apply(labels: DataFrame, moves: DataFrame) -> DataFrame:
    moved = moves.select("node", "target")
    return cut_lineage(labels.join(moved, "node", "left").select("node", F.coalesce("target", "label").alias("label")))


def modularity_communities(edges: DataFrame, resolution: float = 1.0, **hot) -> DataFrame:
    """(node, community_id, community_size) of maximal modularity as far as moves and merges reach.

    A community is named by its smallest node. Joins by community and by the ends of edges are left to Spark, which
    splits hot ones as it meets them; edges of hubs are kept apart (see ``Neighbourhood``). A higher ``resolution`` gives smaller communities. Nodes with
    nothing but a self loop are left out. Results do not depend on how rows are split.
    """
    adjacency = cut_lineage(undirected(edges))
    members = cut_lineage(adjacency.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    while not adjacency.isEmpty():
        labels, before, after = Level(adjacency, resolution, **hot).optimise()
        if after <= before + TOL:
            break
        renamed = labels.join(labels.groupBy("label").agg(F.min("node").alias("name")), "label").select("node", F.col("name").alias("label"))
        renamed = cut_lineage(renamed)
        step = renamed.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        members = cut_lineage(members.join(step, "label").select("node", F.col("_next").alias("label")))
        ends = [renamed.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")) for side in ("src", "dst")]
        both = adjacency.join(ends[0], "src").join(ends[1], "dst")
        adjacency = cut_lineage(both.groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")))
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("community_size", F.col("n"))
    return lookup_by_key(members, sizes, "label", **hot).select("node", F.col("label").alias("community_id"), "community_size")
