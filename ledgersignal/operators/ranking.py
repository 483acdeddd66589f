"""Global ranks and exact quantiles without an unpartitioned window.

Values are first counted (equal values collapse before the shuffle), then laid out by range. Each
range partition sums its own counts; the sums of the partitions before it are the offset. The range
layout is checkpointed because both the sums and the rows must see the same partition numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.operators.skew import fetch_hot, lookup_by_key
from ledgersignal.session import cut_lineage


def running_totals(
    counted: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str], prefix: str = "before_"
) -> DataFrame:
    """For distinct (by, order) rows add, per column of ``sums``, the total over smaller rows."""
    by = list(by)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut_lineage(counted.repartitionByRange(*by, *order_cols).withColumn("_pid", F.spark_partition_id()))
    part_sums = ranged.groupBy("_pid", *by).agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    # One row per (group, range partition): the groups are split over few partitions each, except a
    # global ranking, whose single group has one row per range partition.
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sums.select("_pid", *by, *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    local = Window.partitionBy("_pid", *by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"_l_{s}": F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums})
    joined = inside.join(offsets, ["_pid", *by])
    return joined.withColumns({f"{prefix}{s}": F.col(f"_l_{s}") + F.col(f"_o_{s}") for s in sums}).drop(
        "_pid", *[f"_l_{s}" for s in sums], *[f"_o_{s}" for s in sums]
    )


def melt(df: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Long form (keep..., name, value) of several numeric columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), c.cast("double").alias("value")) for name, c in columns.items()])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.name", "_p.value")


def average_ranks(df: DataFrame, key: str, columns: dict[str, Column], pct: bool = True) -> DataFrame:
    """Average-tie ranks of several columns: (key, name, rank); NULL values get no row.

    With ``pct`` the rank is divided by the number of non-null values of that column.
    """
    long = melt(df, [key], columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, ["name"], ["value"], ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    if pct:
        sizes = placed.groupBy("name").agg(F.sum("n").alias("_size"))
        placed, rank = placed.join(sizes, "name"), rank / F.col("_size")
    table = placed.select("name", "value", "n", rank.alias("rank"))
    return lookup_by_key(long, table, ["name", "value"], how="inner").select(key, "name", "rank")


def rank_columns(
    df: DataFrame, key: str, columns: dict[str, Column], fill: float | None = 0.5, pct: bool = True, suffix: str = "_rank"
) -> DataFrame:
    """Wide form: one ``<name>_rank`` column per ranked column, missing values filled."""
    ranks = average_ranks(df, key, columns, pct)
    wide = ranks.groupBy(key).agg(*[F.max(F.when(F.col("name") == c, F.col("rank"))).alias(c + suffix) for c in columns])
    out = df.select(key).join(wide, key, "left")
    return out.fillna(fill, subset=[c + suffix for c in columns]) if fill is not None else out


def ordinal_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order (``order`` must end in a unique column)."""
    placed = running_totals(df.withColumn("_one", F.lit(1)), [], order, ["_one"])
    return placed.withColumn(name, F.col("before__one") + 1).drop("_one", "before__one")


def _placed_by_group(counted: DataFrame, by: list[str]) -> DataFrame:
    """Running counts within many groups: one window per ordinary group, ranges for hot groups."""
    group = [*by, "name"]
    counted = cut_lineage(counted)  # read twice below
    ordered = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)

    def windowed(df: DataFrame) -> DataFrame:
        return df.withColumns({"before_n": F.coalesce(F.sum("n").over(ordered), F.lit(0)), "_size": F.sum("n").over(Window.partitionBy(*group))})

    hot = fetch_hot(counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    if hot is None:
        return windowed(counted)
    large = counted.join(F.broadcast(hot), by, "left_semi")
    sizes = large.groupBy(*group).agg(F.sum("n").alias("_size"))
    ranged = running_totals(large, group, ["value"], ["n"]).join(sizes, group)
    return windowed(counted.join(F.broadcast(hot), by, "left_anti")).unionByName(ranged)


def exact_quantiles(df: DataFrame, columns: dict[str, Column], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles per (by, column): (by..., name, q, quantile)."""
    by = list(by)
    group = [*by, "name"]
    long = melt(df, by, columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    if by:
        placed = _placed_by_group(counted, by)
    else:
        placed = running_totals(counted, group, ["value"], ["n"])
        placed = placed.join(placed.groupBy(*group).agg(F.sum("n").alias("_size")), group)

    def value_at(position: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n")), F.col("value")))

    aggregates, results = [], []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        aggregates += [value_at(F.floor(pos)).alias(f"_lo{i}"), value_at(F.ceil(pos)).alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
        interpolated = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
        results.append(F.struct(F.lit(float(q)).alias("q"), interpolated.alias("quantile")))
    picked = placed.groupBy(*group).agg(*aggregates)
    return picked.select(*group, F.explode(F.array(*results)).alias("_r")).select(*group, "_r.q", "_r.quantile")


def quantile_row(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with a named quantile per entry: ``{alias: (column, q)}``."""
    qs = sorted({q for _, q in wanted.values()})
    table = exact_quantiles(df, {a: c for a, (c, _) in wanted.items()}, qs)
    return table.agg(*[F.max(F.when((F.col("name") == a) & (F.col("q") == float(q)), F.col("quantile"))).alias(a) for a, (_, q) in wanted.items()])


def row_struct(row: DataFrame) -> Column:
    """A one-row table as a scalar subquery that returns all its columns."""
    return row.select(F.struct(*row.columns).alias("row")).scalar()


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row through one scalar subquery."""
    return df.withColumn("_row", row_struct(row)).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])


def impute_median(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing values with the exact median of the reference (training) rows."""
    medians = quantile_row(reference, {f"_median_{c}": (F.col(c), 0.5) for c in columns})
    filled = attach_row(df, medians)
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(F.col(c), F.col(f"_median_{c}"))), columns, filled).drop(
        *[f"_median_{c}" for c in columns]
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of an order: Spark keeps k rows per task, then merges."""
    return df.orderBy(*order).limit(k)
