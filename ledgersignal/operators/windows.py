"""Suspicious-interval detection: one (start_day, end_day) per account from its daily series.

A daily series has at most one row per calendar day, so an account is a bounded group however many
transactions it has. Range sums are differences of running sums in integer cents: every frame starts
at the first row, which costs one pass per scale, and ties are exact. Ties go to the earliest start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.functions.scalars import total_of
from ledgersignal.operators.ranking import attach_row, exact_quantiles
from ledgersignal.session import cut_lineage

A = "account_id"
START = Window.unboundedPreceding
DENSE_ROWS = 500_000  # Calendar days made by one task.


def _account():
    return Window.partitionBy(A)


def _by_day():
    return Window.partitionBy(A).orderBy("day_no")


def range_sum(daily: DataFrame, days: int, name: str, value: str = "v", end: str | None = None) -> DataFrame:
    """Sum of ``value`` over [day, day + days] and optionally the last active day in it."""
    upto = F.sum(value).over(_by_day().rangeBetween(START, days))
    before = F.coalesce(F.sum(value).over(_by_day().rangeBetween(START, -1)), F.lit(0))
    out = daily.withColumn(name, upto - before)
    return out.withColumn(end, F.max("day_no").over(_by_day().rangeBetween(START, days))) if end else out


def densest(daily: DataFrame, days: int, name: str, value: str = "v") -> DataFrame:
    """Add the account's best window of ``days``: struct (vol, start, end), earliest on ties."""
    marked = range_sum(daily, days, "_wv", value, "_we")
    best = F.max(F.struct(F.col("_wv").alias("vol"), (-F.col("day_no")).alias("neg"), F.col("_we").alias("end"))).over(_account())
    picked = F.struct(best["vol"].alias("vol"), (-best["neg"]).alias("start"), best["end"].alias("end"))
    return marked.withColumn(name, picked).drop("_wv", "_we")


def best_windows(daily: DataFrame, scales: Sequence[int], value: str = "v") -> DataFrame:
    """One row per account: totals and, per scale, the densest window b<days> (vol, start, end).

    All scales share one ordered pass and one aggregate; the account key needs no further shuffle.
    """
    scales = sorted(set(scales))
    before = F.coalesce(F.sum(value).over(_by_day().rangeBetween(START, -1)), F.lit(0))
    sums = {f"_v{w}": F.sum(value).over(_by_day().rangeBetween(START, w)) for w in scales}
    ends = {f"_e{w}": F.max("day_no").over(_by_day().rangeBetween(START, w)) for w in scales}
    marked = daily.withColumns({"_before": before, **sums, **ends})

    def best(w: int) -> Column:
        top = F.max(F.struct((F.col(f"_v{w}") - F.col("_before")).alias("vol"), (-F.col("day_no")).alias("neg"), F.col(f"_e{w}").alias("end")))
        return F.struct(top["vol"].alias("vol"), (-top["neg"]).alias("start"), top["end"].alias("end")).alias(f"b{w}")

    return marked.groupBy(A).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_days"), F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"), *[best(w) for w in scales]
    )


def _totals(daily: DataFrame, min_days: int, value: str = "v") -> DataFrame:
    """Account totals on every row; accounts below the day rule or without volume are dropped."""
    out = daily.withColumns(
        {
            "total": F.sum(value).over(_account()),
            "n_days": F.count(F.lit(1)).over(_account()),
            "first_day": F.min("day_no").over(_account()),
            "last_day": F.max("day_no").over(_account()),
        }
    )
    return out.filter((F.col("n_days") >= min_days) & (F.col("total") > 0))


def _cumulative(df: DataFrame, value: str = "v") -> DataFrame:
    return df.withColumns({"cum": F.sum(value).over(_by_day().rowsBetween(START, 0)), "tot": F.sum(value).over(_account())})


def _quantile_day(percent: Column | int) -> Column:
    """First day whose running share reaches ``percent`` (integer arithmetic, so no rounding)."""
    return F.min(F.when(100 * F.col("cum") >= percent * F.col("tot"), F.col("day_no")))


def volume_cdf(daily: DataFrame) -> DataFrame:
    """Running volume and share per day."""
    return _cumulative(daily).withColumn("cdf", F.col("cum") / F.col("tot"))


def window_minmax(txn: DataFrame) -> DataFrame:
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    return txn.groupBy(A).agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"))


def rolling_z(daily: DataFrame, lookback: int, name: str = "z", value: str = "v") -> DataFrame:
    """Deviation from the previous ``lookback`` active days, 0 before there are that many.

    Mean and population variance come from differences of exact running sums, so the cost does not
    depend on the look-back and a flat history gives exactly 0.
    """
    wide = F.col(value).cast("decimal(19,0)")
    so_far = _by_day().rowsBetween(START, -1)
    running = daily.withColumns(
        {
            "_s": F.coalesce(F.sum(value).over(so_far), F.lit(0)),
            "_q": F.coalesce(F.sum((wide * wide).cast("decimal(38,0)")).over(so_far), F.lit(0)).cast("decimal(38,0)"),
        }
    )
    older = running.withColumns({"_s0": F.lag("_s", lookback).over(_by_day()), "_q0": F.lag("_q", lookback).over(_by_day())})
    s = F.col("_s") - F.col("_s0")
    exact = s.cast("decimal(19,0)")
    n = F.lit(lookback).cast("decimal(10,0)")
    variance = ((n * (F.col("_q") - F.col("_q0"))).cast("decimal(38,0)") - (exact * exact).cast("decimal(38,0)")).cast("double")
    z = (F.lit(lookback) * F.col(value) - s).cast("double") / F.sqrt(variance)
    return older.withColumn(name, F.when(variance > 0, z).otherwise(F.lit(0.0))).drop("_s", "_q", "_s0", "_q0")


def window_two_pass_z(
    daily: DataFrame, coarse: int = 30, coarse_z: float = 2.0, fine: int = 3, fine_z: float = 1.5, margin: int = 15, min_days: int = 10
) -> DataFrame:
    """Coarse z-scores find the active period, fine z-scores inside it set the bounds."""
    base = _totals(daily, min_days)
    base = rolling_z(base.withColumn("rn", F.row_number().over(_by_day())), coarse, "zc")
    any_coarse = F.max((F.col("zc") > coarse_z).cast("int")).over(_account())
    p95 = F.percentile("v", F.lit(0.95)).over(_account())
    flag = F.when(any_coarse == 1, F.col("zc") > coarse_z).otherwise(F.col("v") >= p95)
    base = base.withColumn("_flag", flag)
    hit = F.when(F.col("_flag"), F.col("rn"))
    base = base.withColumns({"_lo": F.min(hit).over(_account()), "_hi": F.max(hit).over(_account())})
    base = base.withColumns(
        {
            "_cs": F.max(F.when(F.col("rn") == F.col("_lo"), F.col("day_no"))).over(_account()),
            "_ce": F.max(F.when(F.col("rn") == F.col("_hi"), F.col("day_no"))).over(_account()),
        }
    )
    # The slice holds rows [lo - margin, hi + margin) counted from zero, hence the -1 at its end.
    inside = base.filter((F.col("rn") >= F.col("_lo") - margin) & (F.col("rn") <= F.col("_hi") + margin - 1))
    inside = rolling_z(inside, fine, "zf").withColumn("_n", F.count(F.lit(1)).over(_account()))
    any_fine = F.max((F.col("zf") > fine_z).cast("int")).over(_account())
    p80 = F.percentile("v", F.lit(0.80)).over(_account())
    day = F.when(F.when(any_fine == 1, F.col("zf") > fine_z).otherwise(F.col("v") >= p80), F.col("day_no"))
    marked = inside.withColumn("_day", day)
    found = marked.groupBy(A).agg(F.max("_n").alias("_n"), F.max("_cs").alias("_cs"), F.max("_ce").alias("_ce"), F.min("_day").alias("_fs"), F.max("_day").alias("_fe"))
    short = F.col("_n") < 5
    return found.select(A, F.when(short, F.col("_cs")).otherwise(F.col("_fs")).alias("start_day"), F.when(short, F.col("_ce")).otherwise(F.col("_fe")).alias("end_day"))


def window_30d_p75(daily: DataFrame, days: int = 30, q: float = 0.75, min_days: int = 5) -> DataFrame:
    """Densest window, then first and last of its high-volume days."""
    base = densest(_totals(daily, min_days), days, "best")
    inside = base.filter(F.col("day_no").between(F.col("best.start"), F.col("best.end")))
    inside = inside.withColumn("_p", F.percentile("v", F.lit(q)).over(_account()))
    high = F.when(F.col("v") >= F.col("_p"), F.col("day_no"))
    return inside.groupBy(A).agg(F.min(high).alias("start_day"), F.max(high).alias("end_day"))


def window_cdf(daily: DataFrame, lo: int = 10, hi: int = 90, min_days: int = 3) -> DataFrame:
    """Days at which the running volume share reaches ``lo`` and ``hi`` percent."""
    base = _cumulative(_totals(daily, min_days))
    return base.groupBy(A).agg(_quantile_day(lo).alias("start_day"), _quantile_day(hi).alias("end_day"))


def _cdf_days(daily: DataFrame, percents: Sequence[int]) -> DataFrame:
    """Per account the days of several running-share percents as columns d<percent>."""
    out = _cumulative(daily)
    return out.withColumns({f"d{p}": F.min(F.when(100 * F.col("cum") >= p * F.col("tot"), F.col("day_no"))).over(_account()) for p in percents})


def _refine(base: DataFrame, slide: int, wide: Column, threshold: Column, keep_last_start: bool) -> DataFrame:
    """Replace bounds (s, e) of wide windows by their densest ``slide``-day part if it is heavy enough.

    ``threshold`` compares the part's volume ``_bv`` with the window's volume ``_cv``.
    """
    inside = base.filter(F.col("day_no").between(F.col("s"), F.col("e")))
    inside = densest(inside, slide, "_slid").withColumn("_cv", F.sum("v").over(_account()))
    if not keep_last_start:
        # Only starts before the last day compete here.
        marked = range_sum(inside, slide, "_wv", "v", "_we")
        candidate = F.when(F.col("day_no") < F.col("e"), F.struct(F.col("_wv").alias("vol"), (-F.col("day_no")).alias("neg"), F.col("_we").alias("end")))
        best = F.max(candidate).over(_account())
        inside = marked.withColumn("_slid", F.when(best.isNotNull(), F.struct(best["vol"].alias("vol"), (-best["neg"]).alias("start"), best["end"].alias("end"))))
    inside = inside.withColumn("_bv", F.coalesce(F.col("_slid.vol"), F.lit(0)))
    use = wide & threshold
    return inside.withColumns(
        {"_ns": F.when(use, F.col("_slid.start")).otherwise(F.col("s")), "_ne": F.when(use, F.col("_slid.end")).otherwise(F.col("e"))}
    ).drop("_slid", "_wv", "_we")


def window_adaptive_cdf(daily: DataFrame) -> DataFrame:
    """Running-share bounds chosen by burstiness, then the densest 60 days of very wide windows."""
    base = _cdf_days(_totals(daily, 3), [5, 8, 10, 20, 80, 90, 92, 95])
    core = F.when(F.col("d80") > F.col("d20"), F.col("d80") - F.col("d20")).otherwise(F.lit(1))
    span = F.col("last_day") - F.col("first_day")
    pick = lambda a, b, c: F.when(core <= 30, F.col(a)).when(span < 90, F.col(b)).otherwise(F.col(c))
    base = base.withColumns({"s": pick("d5", "d8", "d10"), "e": pick("d95", "d92", "d90")})
    refined = _refine(base, 60, F.col("e") - F.col("s") > 180, 2 * F.col("_bv") > F.col("_cv"), keep_last_start=False)
    return refined.groupBy(A).agg(F.max("_ns").alias("start_day"), F.max("_ne").alias("end_day"))


def window_tight_v6(daily: DataFrame, cap: int = 400) -> DataFrame:
    """Tighter running-share bounds by life span, densest 90 days of wide windows, capped length.

    The cap is in days around the day with most transactions.
    """
    base = _cdf_days(_totals(daily, 3), [5, 8, 10, 12, 15, 85, 88, 90, 92, 95])
    core = F.col("d90") - F.col("d10") + 1
    span = F.col("last_day") - F.col("first_day") + 1
    pick = lambda a, b, c, d: F.when(core <= 60, F.col(a)).when(span <= 120, F.col(b)).when(span <= 365, F.col(c)).otherwise(F.col(d))
    base = base.withColumns({"s": pick("d5", "d8", "d12", "d15"), "e": pick("d95", "d92", "d88", "d85")})
    refined = _refine(base, 90, F.col("e") - F.col("s") + 1 > 300, 100 * F.col("_bv") >= 55 * F.col("_cv"), keep_last_start=True)
    inside = refined.filter(F.col("day_no").between(F.col("_ns"), F.col("_ne")))
    peak = F.max(F.struct("n", (-F.col("day_no")).alias("neg")))
    found = inside.groupBy(A).agg(F.max("_ns").alias("s"), F.max("_ne").alias("e"), peak.alias("p"))
    half = cap // 2
    lo = F.greatest(F.col("s"), -F.col("p.neg") - half)
    hi = F.least(F.col("e"), lo + cap)
    lo = F.when(hi == F.col("e"), F.greatest(F.col("s"), hi - cap)).otherwise(lo)
    long = F.col("e") - F.col("s") + 1 > cap
    return found.select(A, F.when(long, lo).otherwise(F.col("s")).alias("start_day"), F.when(long, hi).otherwise(F.col("e")).alias("end_day"))


def window_multiscale(
    daily: DataFrame,
    scales: Sequence[int] = (14, 30, 60, 90),
    coverage: int = 50,
    trim: tuple[int, int] = (5, 95),
    min_days: int = 3,
    trim_min: int = 6,
    fallback: int | None = None,
    ordered_trim: bool = False,
) -> DataFrame:
    """Smallest scale whose densest window covers enough volume, trimmed by running share.

    Without a qualifying scale the whole series is used, or the densest ``fallback`` days.
    ``ordered_trim`` keeps the bounds when the trimmed end would not lie after the trimmed start.
    """
    used = [*scales, fallback] if fallback else list(scales)
    base = best_windows(daily, used).filter((F.col("n_days") >= min_days) & (F.col("total") > 0))

    def choice(b: str, w: int) -> Column:
        return F.struct(F.col(f"{b}.start").alias("start"), F.col(f"{b}.end").alias("end"), F.lit(w).cast("bigint").alias("scale"), F.col(f"{b}.vol").alias("vol"))

    whole = F.struct(F.col("first_day").alias("start"), F.col("last_day").alias("end"), F.lit(None).cast("bigint").alias("scale"), F.col("total").alias("vol"))
    other = choice(f"b{fallback}", fallback) if fallback else whole
    chosen = F.coalesce(*[F.when(100 * F.col(f"b{w}.vol") >= coverage * F.col("total"), choice(f"b{w}", w)) for w in scales], other)
    bounds = base.select(A, chosen.alias("c"), "total", "n_days")
    inside = daily.select(A, "day_no", "v").join(bounds, A).filter(F.col("day_no").between(F.col("c.start"), F.col("c.end")))
    found = _cumulative(inside).groupBy(A).agg(
        _quantile_day(trim[0]).alias("_ts"),
        _quantile_day(trim[1]).alias("_te"),
        F.count(F.lit(1)).alias("_n"),
        F.max("c").alias("c"),
        F.max("total").alias("total"),
        F.max("n_days").alias("n_days"),
    )
    cut = F.col("_n") >= trim_min
    if ordered_trim:
        cut = cut & (F.col("_te") > F.col("_ts"))
    return found.select(
        A,
        F.when(cut, F.col("_ts")).otherwise(F.col("c.start")).alias("start_day"),
        F.when(cut, F.col("_te")).otherwise(F.col("c.end")).alias("end_day"),
        F.col("c.scale").alias("scale_days"),
        (F.col("c.vol") / F.col("total")).alias("coverage"),
        "n_days",
    )


def window_v9(daily: DataFrame) -> DataFrame:
    return window_multiscale(daily, (7, 14, 30, 60, 90, 180), 60, (10, 90), min_days=2, trim_min=4, fallback=90, ordered_trim=True)


def _spread(daily: DataFrame, rows: int = DENSE_ROWS) -> DataFrame:
    """Accounts dealt out so that a task makes about ``rows`` calendar days, however few days were active.

    Partitions sized by the active days alone would hold many times as many rows after the calendar is filled.
    """
    span = daily.groupBy(A).agg((F.max("day_no") - F.min("day_no") + 1).alias("n")).agg(F.sum("n")).first()[0]
    return daily.repartition(max(1, -(-int(span or 0) // rows)), A)


def dense_calendar(daily: DataFrame) -> DataFrame:
    """Every calendar day between the first and last active day, volume 0 on silent days."""
    following = F.lead("day_no").over(_by_day())
    filled = daily.withColumn("_until", F.coalesce(following - 1, F.col("day_no")))
    run = filled.withColumn("_d", F.explode(F.sequence("day_no", "_until")))
    return run.select(A, F.col("_d").alias("day_no"), F.when(F.col("_d") == F.col("day_no"), F.col("v")).otherwise(F.lit(0)).alias("v"))


def rolling_mean(dense: DataFrame, width: int = 5, name: str = "smooth") -> DataFrame:
    """Centred moving average with shrinking edges, as integer multiples (times 60 for width 5).

    60 is divisible by every frame size from 1 to 5, so the smoothed series stays exact.
    """
    half = width // 2
    frame = _by_day().rowsBetween(-half, half)
    return dense.withColumn(name, (F.sum("v").over(frame) * 60 / F.count("v").over(frame)).cast("bigint"))


def window_smoothed_v10(
    daily: DataFrame,
    scales: Sequence[int] = (7, 14, 30, 60, 90, 180, 365),
    coverage: int = 55,
    fallback: int = 90,
    trim: tuple[int, int] = (15, 85),
    min_active: int = 8,
    min_span: int = 30,
    min_trimmed: int = 7,
    expand: int = 3,
) -> DataFrame:
    """Densest windows on a smoothed calendar series, careful trim, widened by a few days."""
    enough = cut_lineage(_totals(daily, 2).select(A, "day_no", "v"))
    base = best_windows(rolling_mean(dense_calendar(_spread(enough))), [*scales, fallback], "smooth")
    bounds = lambda w: F.struct(F.col(f"b{w}.start").alias("start"), F.col(f"b{w}.end").alias("end"))
    chosen = F.coalesce(*[F.when(100 * F.col(f"b{w}.vol") >= coverage * F.col("total"), bounds(w)) for w in scales], bounds(fallback))
    # Silent days add nothing to running shares, so the trim reads the active days only.
    inside = enough.join(base.select(A, chosen.alias("c")), A).filter(F.col("day_no").between(F.col("c.start"), F.col("c.end")))
    found = _cumulative(inside).groupBy(A).agg(
        _quantile_day(trim[0]).alias("_ts"), _quantile_day(trim[1]).alias("_te"), F.count_if(F.col("v") > 0).alias("_active"), F.max("c").alias("c"), F.max("tot").alias("_tot")
    )
    cut = (F.col("_active") >= min_active) & (F.col("c.end") - F.col("c.start") > min_span) & (F.col("_tot") > 0) & (F.col("_te") - F.col("_ts") >= min_trimmed)
    return found.select(
        A,
        (F.when(cut, F.col("_ts")).otherwise(F.col("c.start")) - expand).alias("start_day"),
        (F.when(cut, F.col("_te")).otherwise(F.col("c.end")) + expand).alias("end_day"),
    )


def window_core_expand_v11(daily: DataFrame, outer: int = 30, inner: int = 7, share: int = 4, min_days: int = 2, expand_min: int = 4) -> DataFrame:
    """Densest month by volume x sqrt(count), its densest week, extended over busy neighbours.

    Scores are rounded to whole numbers so that sums and ties are exact. The extension on each side
    stops at the nearest active day whose score is below a quarter of the core mean.
    """
    base = _totals(daily, min_days).withColumn("sc", F.round(F.col("v") * F.sqrt("n")).cast("bigint"))
    base = densest(base, outer, "o", "sc")
    month = base.filter(F.col("day_no").between(F.col("o.start"), F.col("o.end")))
    month = densest(month, inner, "i", "sc").withColumn("_n", F.count(F.lit(1)).over(_account()))
    core = F.col("day_no").between(F.col("i.start"), F.col("i.end"))
    month = month.withColumns({"_cs": F.sum(F.when(core, F.col("sc"))).over(_account()), "_cn": F.count_if(core).over(_account())})
    low = share * F.col("sc") * F.col("_cn") < F.col("_cs")
    left, right = F.col("day_no") < F.col("i.start"), F.col("day_no") > F.col("i.end")
    month = month.withColumns({"_lb": F.max(F.when(left & low, F.col("day_no"))).over(_account()), "_rb": F.min(F.when(right & low, F.col("day_no"))).over(_account())})
    kept = (F.col("_lb").isNull() | (F.col("day_no") > F.col("_lb"))) & (F.col("_rb").isNull() | (F.col("day_no") < F.col("_rb")))
    keep = F.when(F.col("_n") < expand_min, F.col("day_no")).when(kept, F.col("day_no"))
    return month.withColumn("_k", keep).groupBy(A).agg(F.min("_k").alias("start_day"), F.max("_k").alias("end_day"))


def window_freeze_anchor(windows: DataFrame, accounts: DataFrame, mode: str = "extend") -> DataFrame:
    """Move the window end to a freeze date: later dates extend it, or earlier ones cut it."""
    freeze = F.unix_date("freeze_date").cast("bigint")
    joined = windows.select(A, "start_day", "end_day").join(accounts.select(A, freeze.alias("_f")), A, "left")
    if mode == "extend":
        end = F.greatest("end_day", "_f")
    else:
        end = F.when(F.col("_f").between(F.col("start_day"), F.col("end_day")), F.col("_f")).otherwise(F.col("end_day"))
    return joined.select(A, "start_day", end.alias("end_day"))


def gate(scores: DataFrame, threshold: float | Column, factor: float = 1.0, score: str = "score") -> DataFrame:
    """Accounts whose score exceeds ``factor * threshold``."""
    return scores.filter(F.col(score) > F.lit(factor) * (F.lit(threshold) if not isinstance(threshold, Column) else threshold)).select(A)


def window_widths(windows: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Distribution of window widths in days as one row."""
    width = F.col("end_day") - F.col("start_day")
    rows = cut_lineage(windows.select(width.cast("double").alias("w")))
    counts = rows.agg(
        F.count("w").alias("n_windows"),
        F.avg("w").alias("mean_width"),
        *[F.count_if(F.col("w") < k).alias(f"lt_{k}") for k in (30, 60, 90)],
        F.count_if(F.col("w") > 180).alias("gt_180"),
    )
    table = exact_quantiles(rows, {"w": F.col("w")}, qs)
    quantiles = table.agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(f"p{round(q * 100)}") for q in qs])
    return attach_row(counts, quantiles)


def flag_to_open_stats(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """Median days from account opening to the mule flag."""
    days = F.datediff("mule_flag_date", "opening_date")
    rows = labels.filter(F.col("is_mule") == 1).select(A, "mule_flag_date").join(accounts.select(A, "opening_date"), A).select(days.alias("d"))
    table = exact_quantiles(rows, {"d": F.col("d")}, [0.5])
    return table.select(F.col("quantile").alias("median_flag_to_open"))


def temporal_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Overlap over union in whole days per account (0 when a side is missing)."""
    t = truth.select(A, F.col("start_day").alias("_s"), F.col("end_day").alias("_e"))
    joined = predicted.select(A, "start_day", "end_day").join(t, A, "full")
    overlap = F.greatest(F.lit(0), F.least("end_day", "_e") - F.greatest("start_day", "_s") + 1)
    union = total_of([F.col("end_day") - F.col("start_day") + 1, F.col("_e") - F.col("_s") + 1]) - overlap
    both = F.col("start_day").isNotNull() & F.col("_s").isNotNull()
    return joined.select(A, F.when(both, overlap / union).otherwise(F.lit(0.0)).alias("iou"))
