"""Folds and smoothed target encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.operators.ranking import ordinal_rank
from ledgersignal.operators.skew import lookup_by_key
from ledgersignal.sources.adapters import hash_bucket

A = "account_id"


def _prior(train: DataFrame, y: str) -> Column:
    return train.agg(F.avg(y)).scalar()


def target_encode(train: DataFrame, rows: DataFrame, key: str, y: str, alpha: float = 10, name: str = "rate", **hot) -> DataFrame:
    """Smoothed positive rate per key from all training rows; unseen keys get the prior."""
    prior = _prior(train, y)
    stats = train.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(y).alias("_pos"), F.count(y).alias("_cnt"))
    return _apply(rows, stats, key, name, lambda: _smoothed("_pos", "_cnt", alpha, F.col("_mu")), prior, hot=hot)


def _smoothed(pos: str | Column, n: str | Column, alpha: float, prior: Column) -> Column:
    pos, n = (F.col(c) if isinstance(c, str) else c for c in (pos, n))
    return (F.coalesce(pos, F.lit(0)) + alpha * prior) / (F.coalesce(n, F.lit(0)) + alpha)


def _apply(rows: DataFrame, stats: DataFrame, key: str, name: str, value, prior: Column, extra: tuple[str, ...] = (), more: dict[str, Column] | None = None, hot: dict | None = None) -> DataFrame:
    # Every key is as frequent in `rows` as in `rows` itself: count there, so hot keys are known.
    frequency = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_by_key(rows, stats, key, counts=frequency, **(hot or {}))
    return joined.withColumn("_mu", prior).withColumns({name: value(), **(more or {})}).drop("_mu", "_pos", "_cnt", *extra)


def target_encode_oof(
    train: DataFrame, rows: DataFrame | None, key: str, y: str, fold: str, alpha: float = 10, name: str = "rate_oof", full_name: str | None = None, **hot
) -> DataFrame:
    """Rate from the other folds only; ``rows`` have no fold and use all training rows.

    One aggregate by (key, fold) serves every fold: the own fold's sums are subtracted.
    ``full_name`` adds the rate that does not leave the own fold out.
    """
    prior = _prior(train, y)
    per_fold = train.filter(F.col(key).isNotNull()).groupBy(key, fold).agg(F.sum(y).alias("_fpos"), F.count(y).alias("_fcnt"))
    # One entry per fold, so this list is as long as the number of folds.
    folds = F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct("_fpos", "_fcnt"))))
    stats = per_fold.groupBy(key).agg(F.sum("_fpos").alias("_pos"), F.sum("_fcnt").alias("_cnt"), folds.alias("_folds"))

    def own(field: str) -> Column:
        return F.coalesce(F.col("_folds")[F.col(fold)][field], F.lit(0))

    def leave_out() -> Column:
        return _smoothed(F.coalesce(F.col("_pos"), F.lit(0)) - own("_fpos"), F.coalesce(F.col("_cnt"), F.lit(0)) - own("_fcnt"), alpha, F.col("_mu"))

    every = train if rows is None else train.unionByName(rows, allowMissingColumns=True)
    full = {full_name: _smoothed("_pos", "_cnt", alpha, F.col("_mu"))} if full_name else {}
    return _apply(every, stats, key, name, leave_out, prior, ("_folds",), full, hot)


def target_encode_expanding(train: DataFrame, key: str, y: str, bucket: str, folds: int, alpha: float = 10, name: str = "rate_time", **hot) -> DataFrame:
    """Rate from strictly earlier time buckets; the first bucket and the remainder get the prior."""
    prior = _prior(train, y)
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # At most folds + 2 buckets per key, whatever the number of accounts behind a key.
    per = train.groupBy(key, bucket).agg(F.sum(y).alias("_p"), F.count(y).alias("_c"), F.count(F.lit(1)).alias("n"))
    stats = per.select(key, bucket, "n", F.sum("_p").over(earlier).alias("_pos"), F.sum("_c").over(earlier).alias("_cnt"))
    joined = lookup_by_key(train, stats, [key, bucket], **hot).withColumn("_mu", prior)
    used = F.col(bucket).between(1, folds)
    return joined.withColumn(name, F.when(used, _smoothed("_pos", "_cnt", alpha, F.col("_mu"))).otherwise(F.col("_mu"))).drop("_mu", "_pos", "_cnt")


def stratified_folds(df: DataFrame, k: int, seed: int = 42, key: str = A, name: str = "fold") -> DataFrame:
    """Deterministic fold by hash of seed and id.

    A uniform hash gives every fold the same expected class shares, without any shuffle.
    """
    return df.withColumn(name, hash_bucket(key, str(seed), k))


def time_rank(df: DataFrame, date: str, key: str = A, name: str = "time_rank") -> DataFrame:
    """Position by date, missing dates last, ties by id."""
    return ordinal_rank(df, [F.col(date).asc_nulls_last(), F.col(key)], name)


def time_folds(df: DataFrame, date: str, k: int = 5, key: str = A, name: str = "bucket") -> DataFrame:
    """Equal slices of the time order: slice i validates after training on slices below i."""
    ranked = time_rank(df, date, key)
    step = df.agg(F.floor(F.count(F.lit(1)) / (k + 1))).scalar()
    return ranked.withColumn("_step", step).withColumn(name, F.floor((F.col("time_rank") - 1) / F.col("_step")).cast("bigint")).drop("_step")


def usable_folds(df: DataFrame, y: str, bucket: str, k: int) -> DataFrame:
    """Time folds whose training part holds both classes: (fold, n_train, n_valid, n_pos)."""
    per = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("c"), F.sum(y).alias("p"))
    # At most k + 2 rows from here on.
    folds = per.filter(F.col(bucket) <= k).withColumn("_fold", F.explode(F.sequence(F.greatest(F.col(bucket), F.lit(1)), F.lit(k).cast("bigint"))))
    train = F.col(bucket) < F.col("_fold")
    out = folds.groupBy("_fold").agg(
        F.coalesce(F.sum(F.when(train, F.col("c"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(~train, F.col("c"))), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(F.when(train, F.col("p"))), F.lit(0)).alias("n_pos"),
    )
    return out.withColumnRenamed("_fold", "fold").filter((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_train")))
