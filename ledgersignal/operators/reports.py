"""Report queries over a submission table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.operators.ranking import attach_row
from ledgersignal.sources.readers import submission_rows

A = "account_id"


def overview(sub: DataFrame, cut: float = 0.5, score: str = "score") -> DataFrame:
    flagged = F.count_if(F.col(score) > cut)
    n = F.count(F.lit(1))
    return sub.agg(n.alias("n_accounts"), flagged.alias("n_flagged"), (100 * flagged / n).alias("pct_flagged"))


def high_risk(sub: DataFrame, cut: float = 0.8, score: str = "score", k: int | None = None) -> DataFrame:
    out = sub.filter(F.col(score) > cut).orderBy(F.col(score).desc(), A)
    return out.limit(k) if k else out


def score_histogram(sub: DataFrame, bins: int = 20, score: str = "score") -> DataFrame:
    """Equal-width bins between the smallest and largest score; the last bin includes its end."""
    bounds = sub.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col(score) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = attach_row(sub.select(score), bounds).select(index.cast("bigint").alias("bin"), "_lo", width.alias("_w"))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
    every = sub.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = attach_row(every.join(counted, "bin", "left"), bounds).fillna(0, subset=["n_rows"])
    edge = lambda k: F.col("_lo") + (F.col("bin") + k) * width
    return out.select("bin", edge(0).alias("lower"), edge(1).alias("upper"), "n_rows")


def lookup(sub: DataFrame, account_id) -> DataFrame:
    return sub.filter(F.col(A) == account_id)


def assemble_submission(test: DataFrame, scores: DataFrame, windows: DataFrame) -> DataFrame:
    """Every test account with its score and window text (empty without a window)."""
    return submission_rows(test.select(A).join(scores.select(A, "score"), A, "left"), windows)


def rule_dampen(p: Column | str, n_signals: Column | str, floor: float = 0.3) -> Column:
    """Reduce high scores that few signals support."""
    p, n = (F.col(x) if isinstance(x, str) else x for x in (p, n_signals))
    return F.when((p > floor) & (n < 2), p * 0.6).when((p > floor) & (n < 3), p * 0.8).otherwise(p)
