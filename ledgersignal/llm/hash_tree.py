"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over region and rack to a shard. At each level every child draws an
exponential variate from a hash of (document id, child), divided by the child's weight, and the smallest
draw wins, so a child gets documents in proportion to its weight. A change of one child's weight moves
documents only between that child and its siblings, below the parent whose children's weights changed.
A further shard is hung below the root as a region of its own: documents move into it and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import text_key, whole_text
from ledgersignal.operators.ranking import running_totals

RACK_SHARDS, REGION_RACKS = 4, 2
#: Shards that the tree is laid out for; those beyond it are added one by one.
BASE = 16

#: A tree is a list of regions, a region a list of racks, a rack a list of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def balanced_tree(shards: int, weights: dict[int, float] | None = None) -> Tree:
    """Racks of ``RACK_SHARDS`` shards, regions of ``REGION_RACKS`` racks, filled in shard order."""
    leaves = [(s, float((weights or {}).get(s, 1.0))) for s in range(shards)]
    racks = [leaves[i : i + RACK_SHARDS] for i in range(0, shards, RACK_SHARDS)]
    return [racks[i : i + REGION_RACKS] for i in range(0, len(racks), REGION_RACKS)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    last = max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(last + 1, weight)]]]


def tree_of(shards: int, base: int | None = None, weights: dict[int, float] | None = None) -> Tree:
    """The tree of ``shards`` shards by its history: ``base`` shards laid out at once, then grown one by one.

    Of two trees with the same base the larger is the smaller one grown, so every document either stays or goes
    to a further shard. Without a base, trees of ``BASE`` shards and more have that base, and smaller ones 1.
    """
    base = (BASE if shards >= BASE else 1) if base is None else base
    if not 1 <= base <= shards:
        raise ValueError(f"{shards} shards cannot grow from {base}")
    tree = balanced_tree(base, weights)
    for s in range(base, shards):
        tree = grown(tree, float((weights or {}).get(s, 1.0)))
    return tree


def _draw(key: Column, child: str, weight: float) -> Column:
    """Exponential draw of a child; infinite for weight 0."""
    if weight <= 0:
        return F.lit(float("inf"))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(child), key), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.ln(unit) / F.lit(weight)


def _winner(key: Column, children: list[tuple[str, int, float]]) -> Column:
    if len(children) == 1:
        return F.lit(children[0][1])
    draws = [F.struct(_draw(key, name, w).alias("draw"), F.lit(number).alias("number")) for name, number, w in children]
    return F.array_min(F.array(*draws))["number"]


def _case(on: Column, branches: list[tuple[int, Column]]) -> Column:
    out = F.when(on == branches[0][0], branches[0][1])
    for number, value in branches[1:]:
        out = out.when(on == number, value)
    return out


def assign(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` (numbered over all regions) and ``shard`` columns, each with the prefix."""
    racks, regions = [], []
    for r, region in enumerate(tree):
        first = len(racks)
        racks += [(r, rack) for rack in region]
        regions.append((r, first, sum(w for rack in region for _, w in rack)))
    rack_of = [
        (r, _winner(key, [(f"rack{k}", k, sum(w for _, w in rack)) for k, (at, rack) in enumerate(racks) if at == r])) for r, _, _ in regions
    ]
    shard_of = [(k, _winner(key, [(f"shard{s}", s, w) for s, w in rack])) for k, (_, rack) in enumerate(racks)]
    region_c, rack_c, shard_c = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    return (
        df.withColumn(region_c, _winner(key, [(f"region{r}", r, w) for r, _, w in regions]))
        .withColumn(rack_c, _case(F.col(region_c), rack_of))
        .withColumn(shard_c, _case(F.col(rack_c), shard_of))
    )


def shard_documents(docs: DataFrame, shards: int = BASE, base: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its shard now and with one more shard, and its slot within the shard.

    The law is ``key``: id and shard count decide (and the base, see ``tree_of``). A run with one more
    shard and the same base gives what ``grown_shard`` says. Null ids count as one id, so such rows share a shard;
    a null text has size 1. Repeated rows share a shard and get slots of their own. Slots number the rows
    of a shard from 0 by (id, text); they come from running totals over ranges, so that no shard is sorted
    in one task. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        text_key(whole_text()).alias("_text"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    tree = tree_of(shards, base)
    placed = assign(assign(rows, key, tree), key, grown(tree), "grown_")
    counted = running_totals(placed.withColumn("_one", F.lit(1).cast("long")), ["shard"], ["doc_id", "_text"], ["_one"])
    return counted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("before__one").cast("long").alias("slot"), "grown_shard", "region", "rack"
    )


def place(docs: DataFrame, shards: int = BASE, base: int | None = None) -> DataFrame:
    """All columns of ``docs`` and the shard of each row, one scan and no shuffle."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    marked = assign(docs, key, tree_of(shards, base), "_tree_")
    return marked.select(*docs.columns, F.col("_tree_shard").alias("shard"))
