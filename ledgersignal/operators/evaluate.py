"""Evaluation of scores against labels, and quality reports of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.operators.ranking import attach_row, exact_quantiles, melt, running_totals


def _by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    """Distinct scores with class counts: all rows of a score collapse before the shuffle."""
    pos = F.sum(F.col(y)).alias("pos")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(pos, F.sum(1 - F.col(y)).alias("neg"))


def auc(df: DataFrame, score: str = "score", y: str = "is_mule") -> DataFrame:
    """Exact ROC-AUC with half credit for ties: (auc, n_pos, n_neg)."""
    placed = running_totals(_by_score(df, score, y), [], ["score"], ["neg"])
    wins = F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg")))
    sums = placed.agg(wins.alias("w2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select((F.col("w2") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def pr_curve(df: DataFrame, score: str = "score", y: str = "is_mule") -> DataFrame:
    """Precision and recall at every distinct score (prediction is score >= threshold)."""
    placed = running_totals(_by_score(df, score, y), [], [F.col("score").desc()], ["pos", "neg"])
    totals = df.agg(F.sum(y).alias("_all_pos"))
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return attach_row(placed, totals).select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (tp / (tp + fp)).alias("precision"), (tp / F.col("_all_pos")).alias("recall"))


def _fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    den = (1 + b2) * tp + b2 * fn + fp
    return F.when(den > 0, (1 + b2) * tp / den).otherwise(F.lit(0.0))


def grid_points(lo: float, hi: float, step: float) -> list[float]:
    count = round((hi - lo) / step)
    return [round(lo + i * step, 6) for i in range(count)]


def threshold_table(df: DataFrame, grid: Sequence[float], score: str = "score", y: str = "is_mule") -> DataFrame:
    """Confusion counts and F scores for every threshold (prediction is score > threshold).

    Each score is placed on the grid once. The grid index is guessed by arithmetic and corrected by
    comparing with the neighbouring grid values, so it is exact for values on the grid.
    """
    points, g = [float(t) for t in grid], len(grid)
    step = (points[-1] - points[0]) / max(g - 1, 1) or 1.0
    literal = F.array(*[F.lit(t) for t in points])
    guess = F.greatest(F.lit(0), F.least(F.lit(g), F.floor((F.col(score) - points[0]) / step).cast("int") - 1))
    above = lambda k: F.coalesce((F.col(score) > F.try_element_at(literal, F.col("_g") + F.lit(k))).cast("int"), F.lit(0))
    placed = df.select(score, y).withColumn("_g", guess).withColumn("passed", F.col("_g") + above(1) + above(2) + above(3))
    counts = placed.groupBy("passed").agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    frame = df.sparkSession.range(1, g + 1).select(F.col("id").cast("int").alias("passed"), F.element_at(literal, F.col("id").cast("int")).alias("threshold"))
    # The windows below run over the grid, whose length is a parameter, not over the rows.
    rows = frame.join(counts, "passed", "left").fillna(0, subset=["pos", "neg"])
    onward = Window.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.agg(F.sum(y).alias("_p"), F.sum(1 - F.col(y)).alias("_n"))
    out = attach_row(rows.withColumns({"tp": F.sum("pos").over(onward), "fp": F.sum("neg").over(onward)}), totals)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("_p") - F.col("tp")
    return out.select("threshold", "tp", "fp", fn.alias("fn"), (F.col("_n") - fp).alias("tn"), _fbeta(tp, fp, fn, 1).alias("f1"), _fbeta(tp, fp, fn, 2).alias("f2"))


def threshold_sweep(df: DataFrame, grid: Sequence[float], weights: tuple[float, float] = (1.0, 0.0), score: str = "score", y: str = "is_mule") -> DataFrame:
    """Best threshold for a weighted F1/F2 objective; the lowest threshold wins ties."""
    table = threshold_table(df, grid, score, y)
    objective = F.round(weights[0] * F.col("f1") + weights[1] * F.col("f2"), 12)
    best = F.max_by(F.struct("threshold", "tp", "fp", "fn", "tn", "f1", "f2"), F.struct(objective, -F.col("threshold")))
    return table.agg(best.alias("b")).select("b.*")


def confusion(df: DataFrame, threshold: float | Column, score: str = "score", y: str = "is_mule") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col("_s") > F.col("_t"), F.col("_y") == 1
    counts = df.select(F.col(score).alias("_s"), F.col(y).alias("_y"), t.alias("_t")).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tn", "fp", "fn", "tp",
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        _fbeta(tp, fp, fn, 1).alias("f1"),
        _fbeta(tp, fp, fn, 2).alias("f2"),
    )


def prob_errors(df: DataFrame, score: str = "score", y: str = "is_mule", eps: float = 1e-8) -> DataFrame:
    p, t = F.col(score), F.col(y).cast("double")
    bounded = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0))
    diff = p - t
    log_diff = F.log1p(bounded(p)) - F.log1p(bounded(t))
    out = df.agg(
        F.avg(F.abs(diff)).alias("mae"),
        F.avg(diff * diff).alias("mse"),
        F.sqrt(F.avg(log_diff * log_diff)).alias("rmsle"),
        (100 * F.avg(2 * F.abs(diff) / (F.abs(p) + F.abs(t) + eps))).alias("smape"),
    )
    return out.withColumn("rmse", F.sqrt("mse"))


def calibration_check(df: DataFrame, score: str = "score", y: str = "is_mule", cuts: Sequence[float] = (0.3, 0.5, 0.8)) -> DataFrame:
    """Mean score against base rate, rows above cuts against expected positives."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        F.avg(y).alias("base_rate"),
        F.sum(y).alias("expected"),
        *[F.count_if(F.col(score) > cut).alias(f"above_{round(cut * 100)}") for cut in cuts],
    )


def _unpivot(row: DataFrame, prefixes: Sequence[str], columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(col).alias("feature"), *[F.col(f"{p}{col}").alias(n) for p, n in zip(prefixes, names, strict=True)]) for col in columns]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def feature_quality(feat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values per column in one pass."""
    shares = feat.agg(*[F.avg(F.col(x).isNull().cast("double")).alias(f"n_{x}") for x in columns])
    out = _unpivot(shares, ["n_"], columns, ["null_share"])
    return out.withColumns({"mostly_null": (F.col("null_share") > 0.5).cast("int"), "complete": (F.col("null_share") == 0).cast("int")})


def corr_with_target(feat: DataFrame, y: str, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Absolute Pearson correlation with the label, strongest first; NULL for a constant column."""
    label = F.col(y).cast("double")

    def corr(x: str) -> Column:
        value = F.col(x).cast("double")
        spread = F.stddev_pop(F.when(label.isNotNull(), value)) * F.stddev_pop(F.when(value.isNotNull(), label))
        return F.try_divide(F.covar_pop(value, label), spread)

    row = feat.agg(*[corr(x).alias(f"c_{x}") for x in columns])
    out = _unpivot(row, ["c_"], columns, ["_c"]).select("feature", F.abs("_c").alias("abs_corr"))
    return out.orderBy(F.col("abs_corr").desc_nulls_last(), "feature").limit(k) if k else out


def class_ratio_report(feat: DataFrame, y: str, columns: Sequence[str], strong: float = 0.15) -> DataFrame:
    """Mean per class, their ratio, and whether it is clearly off one."""
    side = lambda v, x: F.avg(F.when(F.col(y) == v, F.col(x).cast("double")))
    row = feat.agg(*[side(1, x).alias(f"m_{x}") for x in columns], *[side(0, x).alias(f"l_{x}") for x in columns])
    out = _unpivot(row, ["m_", "l_"], columns, ["mule_mean", "other_mean"])
    ratio = F.when(F.col("other_mean") > 0, F.col("mule_mean") / F.col("other_mean"))
    return out.withColumn("ratio", ratio).withColumn("strong", F.coalesce((F.abs(F.col("ratio") - 1) > strong).cast("int"), F.lit(1)))


def describe(feat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column with exact quartiles."""
    cols = {x: F.col(x) for x in columns}
    long = melt(feat, [], cols).filter(F.col("value").isNotNull())
    basic = long.groupBy("name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    table = exact_quantiles(feat, cols, [0.25, 0.5, 0.75])
    quartiles = table.groupBy("name").agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return basic.join(quartiles, "name").withColumnRenamed("name", "feature")


def score_overview(sub: DataFrame, score: str = "score", cuts: Sequence[float] = (0.3, 0.5, 0.8)) -> DataFrame:
    return sub.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        *[F.count_if(F.col(score) > cut).alias(f"above_{round(cut * 100)}") for cut in cuts],
        F.count_if(F.coalesce(F.col("suspicious_start"), F.lit("")) != "").alias("with_window"),
    )
