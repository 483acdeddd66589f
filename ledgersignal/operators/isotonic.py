"""Isotonic calibration without a pass through the driver or one task.

Neighbouring scores whose rates fall are pooled into one block. Pooled blocks can be pooled again: the blocks of a
range of scores stand for all its rows, and the blocks of neighbouring ranges merge into those of their union. So
every range of scores is pooled by itself, and then ``FAN`` ranges at a time. The blocks of N rows have growing
rates that are fractions of whole numbers with denominators of N in total, so there are fewer than
3 * N ** (2 / 3) of them, however many different scores there are; with real scores it is some hundred.

Rows without a score (NULL or NaN) or without a label take no part in the fit; a row without a score has no
calibrated one. Without any row to fit every result is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.operators.skew import lookup_by_key
from ledgersignal.session import cut_lineage

FAN = 16
BLOCK = "part bigint, lo double, hi double, n bigint, pos bigint, next_lo double, next_rate double"


def _finished(part: int, blocks: list[list]) -> pd.DataFrame:
    out = pd.DataFrame([[part, *b] for b in blocks], columns=["part", "lo", "hi", "n", "pos"])
    return out.assign(next_lo=out.lo.shift(-1), next_rate=(out.pos / out.n).shift(-1))


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators over rows in order of (part, lo); a new part begins anew. Holds one part's blocks."""
    current, blocks = None, []
    for frame in frames:
        for part, lo, hi, n, pos in zip(*(frame[c].tolist() for c in ("part", "lo", "hi", "n", "pos")), strict=True):
            if part != current:
                if blocks:
                    yield _finished(current, blocks)
                current, blocks = part, []
            while blocks and blocks[-1][3] * n >= pos * blocks[-1][2]:  # whole numbers, so equal rates are equal
                before = blocks.pop()
                lo, n, pos = before[0], before[2] + n, before[3] + pos
            blocks.append([lo, hi, n, pos])
    if blocks:
        yield _finished(current, blocks)


def fit_isotonic(df: DataFrame, score: str, y: str) -> DataFrame:
    """Blocks of the monotone map: (lo, hi, n, rate, next_lo, next_rate); ``y`` is 0 or 1."""
    x = F.col(score).cast("double")
    known = df.filter(x.isNotNull() & ~F.isnan(x) & F.col(y).isNotNull())
    points = known.groupBy(x.alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    ranged = points.repartitionByRange("lo").select(F.spark_partition_id().cast("bigint").alias("part"), "lo", F.col("lo").alias("hi"), "n", "pos")
    blocks = cut_lineage(ranged.sortWithinPartitions("part", "lo").mapInPandas(_pool, BLOCK))
    last = blocks.agg(F.max("part")).first()[0] or 0
    while last > 0:
        last //= FAN
        merged = blocks.select((F.floor(F.col("part") / FAN)).alias("part"), "lo", "hi", "n", "pos").repartition("part")
        blocks = cut_lineage(merged.sortWithinPartitions("part", "lo").mapInPandas(_pool, BLOCK))
    return blocks.select("lo", "hi", "n", (F.col("pos") / F.col("n")).alias("rate"), "next_lo", "next_rate")


def _last_block(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """(x, n, step): the last block that begins at or below each score, NULL below the first.

    Scores and blocks are laid out together by range; each range hands its last block to the later ones.
    """
    block = F.struct("lo", "hi", "rate", "next_lo", "next_rate")
    starts = steps.select(F.col("lo").alias("x"), F.lit(None).cast("bigint").alias("n"), block.alias("step"))
    empty = F.lit(None).cast(starts.schema["step"].dataType)
    both = scores.select("x", "n", empty.alias("step")).unionByName(starts)
    ranged = cut_lineage(both.repartitionByRange("x").withColumn("_pid", F.spark_partition_id()))
    upward = Window.partitionBy("_pid").orderBy("x", F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_here", F.last("step", ignorenulls=True).over(upward)).filter(F.col("n").isNotNull())
    # One row per range partition, not per score.
    ends = ranged.groupBy("_pid").agg(F.max_by("step", F.when(F.col("step").isNotNull(), F.col("x"))).alias("_end"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_pid", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return inside.join(carried, "_pid").select("x", "n", F.coalesce("_here", "_carried").alias("step"))


def apply_isotonic(df: DataFrame, score: str, steps: DataFrame, name: str = "calibrated") -> DataFrame:
    """Add the calibrated score: a block's rate inside it, a straight line between two blocks, flat outside."""
    x = F.col(score).cast("double")
    keyed = df.withColumn("_x", F.when(~F.isnan(x), x + F.lit(0.0)))
    scores = keyed.filter(F.col("_x").isNotNull()).groupBy(F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    first = steps.agg(F.min_by("rate", "lo")).scalar()
    s = lambda field: F.col(f"step.{field}")
    slope = (s("next_rate") - s("rate")) / (s("next_lo") - s("hi"))
    between = (F.col("x") > s("hi")) & s("next_lo").isNotNull()
    value = F.when(F.col("step").isNull(), first).when(between, s("rate") + slope * (F.col("x") - s("hi"))).otherwise(s("rate"))
    table = cut_lineage(_last_block(scores, steps).select(F.col("x").alias("_x"), "n", value.alias(name)))
    return lookup_by_key(keyed, table, "_x").select(*df.columns, name)
