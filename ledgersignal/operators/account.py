"""Account-level aggregation: one row per account from ledgers and dimension tables.

Ledger groups that share a key are computed in one aggregate over the pruned scan, so a hot account
is reduced inside the map tasks before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators.ranking import exact_quantiles
from ledgersignal.operators.skew import lookup_by_key, with_neighbours

A = "account_id"


def _money(cents: Column) -> Column:
    return cents / 100


def _share(condition: Column, n: Column) -> Column:
    return F.count_if(condition) / n


def _core() -> dict[str, Column]:
    a = F.abs("amount")
    c = S.cents(a)
    return {
        "txn_count": F.count(F.lit(1)),
        "total_volume": _money(F.sum(c)),
        "amt_mean": F.sum(c) / F.count(c) / 100,
        "amt_std": F.stddev_samp(a),
        "amt_max": F.max(a),
    }


def _flow() -> dict[str, Column]:
    c = S.cents(F.abs("amount"))
    side = lambda t: F.coalesce(_money(F.sum(F.when(F.col("txn_type") == t, c))), F.lit(0.0))
    return {"credit_volume": side("C"), "debit_volume": side("D")}


def _behaviour() -> dict[str, Column]:
    a, n = F.abs("amount"), F.count(F.lit(1))
    flags = {
        ("near_threshold_count", "near_threshold_pct"): S.near_threshold(a),
        ("round_count", "round_amount_pct"): S.is_round_amount(a),
        ("small_count", "life_ratio"): S.is_small(a),
        ("night_count", "night_txn_pct"): S.is_night(F.hour("ts")),
    }
    out = {}
    for (count, share), flag in flags.items():
        out[count], out[share] = F.count_if(flag), _share(flag, n)
    return out


def _refined() -> dict[str, Column]:
    a, n = F.abs("amount"), F.count(F.lit(1))
    return {
        "struct_48_50_pct": _share(S.struct_band_48_50(a), n),
        "struct_45_50_pct": _share(S.struct_band_45_50(a), n),
        "weekend_pct": _share(S.is_weekend("ts"), n),
        "large_round_pct": _share(S.is_large_round(a), n),
        "exact_round_pct": _share(S.is_exact_round(a), n),
        "month_boundary_pct": _share(S.is_month_boundary(F.dayofmonth("ts")), n),
        "max_single_txn_pct": S.safe_ratio(F.max(a), _money(F.sum(S.cents(a)))),
        "reversal_ratio": _share(F.col("amount") < 0, n),
    }


def _first_large() -> dict[str, Column]:
    return {"first_large_ts": F.min(F.when(S.is_large(F.abs("amount")), F.col("ts")))}


PROFILE_PARTS = {"core": _core, "flow": _flow, "behaviour": _behaviour, "refined": _refined, "first_large": _first_large}


def account_profile(txn: DataFrame, parts: Sequence[str] = tuple(PROFILE_PARTS)) -> DataFrame:
    """Any of the count, volume and share groups in one aggregate over one scan."""
    return txn.groupBy(A).agg(*[c.alias(name) for part in parts for name, c in PROFILE_PARTS[part]().items()])


def core_stats(txn: DataFrame) -> DataFrame:
    """Count, volume, mean, sample std and maximum of absolute amounts."""
    return account_profile(txn, ["core"])


def flow_split(txn: DataFrame) -> DataFrame:
    """Credit and debit volume, 0 when there is none."""
    return account_profile(txn, ["flow"])


def behaviour_counts(txn: DataFrame) -> DataFrame:
    """Structuring, round, small and night counts with their shares of all transactions."""
    return account_profile(txn, ["behaviour"])


def refined_counts(txn: DataFrame) -> DataFrame:
    """Narrow structuring bands, weekend, round and month-boundary shares, reversals."""
    return account_profile(txn, ["refined"])


def distinct_counts(txn: DataFrame, approximate: bool = False, mcc: DataFrame | None = None, mcc_counts: DataFrame | None = None) -> DataFrame:
    """Distinct counterparties (all, credit, debit), MCCs, channels and active days.

    The three counterparty counts share one de-duplication by (account, counterparty), done inside
    the map tasks first. ``approximate`` switches to mergeable sketches when the pairs themselves
    are too many. ``mcc`` gives the (account, MCC) rows apart, for a ledger laid out by account: then every
    count is an aggregate of its own, as several distinct counts in one would deal the rows out anew.
    ``mcc_counts`` gives (account, ``mcc_nunique``) instead.
    """
    cp = F.col("counterparty_id")
    credit, debit = F.col("txn_type") == "C", F.col("txn_type") == "D"
    others = {"mcc_nunique": F.col("mcc_code"), "channel_diversity": F.col("channel"), "active_days": F.to_date("ts")}
    if approximate:
        families = {"degree_centrality": cp, "credit_cp_n": F.when(credit, cp), "debit_cp_n": F.when(debit, cp), **others}
        return txn.groupBy(A).agg(*[F.approx_count_distinct(c).alias(name) for name, c in families.items()])
    seen = txn.groupBy(A, "counterparty_id").agg(F.max(credit).alias("_c"), F.max(debit).alias("_d"))
    known = cp.isNotNull()
    counterparties = seen.groupBy(A).agg(
        F.count_if(known).alias("degree_centrality"), F.count_if(known & F.col("_c")).alias("credit_cp_n"), F.count_if(known & F.col("_d")).alias("debit_cp_n")
    )
    if mcc is not None or mcc_counts is not None:
        for name, c in others.items():
            if name == "mcc_nunique" and mcc_counts is not None:
                counts = mcc_counts.select(A, name)
            else:
                counts = (mcc if name == "mcc_nunique" else txn).groupBy(A).agg(F.count_distinct(c).alias(name))
            counterparties = counterparties.join(counts, A)
        return counterparties
    rest = txn.groupBy(A).agg(*[F.count_distinct(c).alias(name) for name, c in others.items()])
    return counterparties.join(rest, A)


def fan_ratio(features: DataFrame) -> DataFrame:
    return features.withColumn("fan_ratio", S.safe_ratio("credit_cp_n", "debit_cp_n"))


def entropy(txn: DataFrame, column: str, name: str, min_rows: int = 1, below: float | None = None) -> DataFrame:
    """Base-2 entropy of a key per account; ``below`` is used when fewer than ``min_rows`` rows."""
    counts = txn.filter(F.col(column).isNotNull()).groupBy(A, column).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    value = F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total
    by_account = counts.groupBy(A).agg(total.alias("_n"), value.alias(name))
    bounded = F.when(F.col("_n") >= min_rows, F.greatest(F.col(name), F.lit(0.0))).otherwise(F.lit(below).cast("double"))
    return by_account.select(A, bounded.alias(name))


def counterparty_entropy(txn: DataFrame) -> DataFrame:
    return entropy(txn, "counterparty_id", "counterparty_entropy")


def mcc_entropy(txn: DataFrame) -> DataFrame:
    return entropy(txn, "mcc_code", "mcc_entropy", min_rows=5)


def first_large(txn: DataFrame, accounts: DataFrame, limit: float = S.LARGE_AMOUNT) -> DataFrame:
    """First timestamp above the limit and whole days between opening and it."""
    first = txn.filter(S.is_large(F.abs("amount"), limit)).groupBy(A).agg(F.min("ts").alias("first_large_ts"))
    joined = accounts.select(A, "opening_date").join(first, A, "left")
    return joined.withColumn("days_to_first_large", days_to_first_large()).drop("opening_date")


def days_to_first_large() -> Column:
    """Whole days from ``opening_date`` to ``first_large_ts``."""
    seconds = F.timestamp_diff("SECOND", F.col("opening_date").cast("timestamp_ntz"), F.col("first_large_ts").cast("timestamp_ntz"))
    return F.floor(seconds / 86400)


def median_dwell(pairs: DataFrame) -> DataFrame:
    """Exact median of dwell hours per account, also for accounts with very many pairs."""
    table = exact_quantiles(pairs, {"dwell": F.col("dwell_hours")}, [0.5], by=[A])
    return table.select(A, F.col("quantile").alias("median_dwell_hours"))


#: Size of the quantile sketch: ranks are off by at most 1.4 % of the rows for 99 of 100 sketches.
SKETCH_K, SKETCH_ERROR = 200, 0.014
_SUMS = ("n", "sum_cents", "sum_sq_cents")


def partial_stats(txn: DataFrame, batch: str | None) -> DataFrame:
    """Mergeable partials per account (and batch): counts, moments, extremes, distinct and quantile sketches."""
    c = S.cents(F.abs("amount"))
    wide = c.cast("decimal(20,0)")
    return txn.groupBy(A, *([batch] if batch else [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(c).alias("sum_cents"),
        F.sum((wide * wide).cast("decimal(38,0)")).alias("sum_sq_cents"),
        F.min(c).alias("min_cents"),
        F.max(c).alias("max_cents"),
        F.hll_sketch_agg(F.col("counterparty_id").cast("string"), F.lit(14)).alias("cp_sketch"),
        F.kll_sketch_agg_bigint(c, SKETCH_K).alias("amt_sketch"),
    )


def combine_partials(partials: DataFrame) -> DataFrame:
    """One row of partials per account. An account has as many rows as batches, whose sketches meet in one list."""
    merged = partials.groupBy(A).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("min_cents").alias("min_cents"),
        F.max("max_cents").alias("max_cents"),
        F.hll_union_agg("cp_sketch").alias("cp_sketch"),
        F.collect_list("amt_sketch").alias("_sketches"),
    )
    first, rest = F.element_at("_sketches", 1), F.slice("_sketches", 2, F.greatest(F.size("_sketches") - 1, F.lit(0)))
    one = F.aggregate(rest, first, lambda have, more: F.kll_sketch_merge_bigint(have, more))
    kinds = {f.name: f.dataType for f in partials.schema}
    return merged.select(A, *[F.col(c).cast(kinds[c]).alias(c) for c in _SUMS], "min_cents", "max_cents", "cp_sketch", one.alias("amt_sketch"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Final statistics from stored partials.

    Counts and moments do not depend on how rows were split into batches; distinct counts and quantiles are
    estimates within the bounds of their sketches.
    """
    merged = combine_partials(partials)
    n, s = F.col("n"), F.col("sum_cents")
    spread = F.col("sum_sq_cents").cast("double") - s.cast("double") * s / n
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("amt_sketch", F.lit(q)) / 100
    return merged.select(
        A,
        n.alias("txn_count"),
        (s / 100).alias("total_volume"),
        (s / n / 100).alias("amt_mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)) / 100).alias("amt_std"),
        (F.col("min_cents") / 100).alias("amt_min"),
        (F.col("max_cents") / 100).alias("amt_max"),
        F.hll_sketch_estimate("cp_sketch").alias("cp_estimate"),
        *[quantile(q).alias(f"amt_p{round(100 * q)}") for q in (0.25, 0.5, 0.9)],
    )


def judged_estimates(merged: DataFrame, txn: DataFrame, q: str = "amt_p50", share: float = 0.5) -> DataFrame:
    """Merged statistics with two flags: the estimated quantile and the distinct estimate are within their bounds.

    A quantile is within its bound if the ranks of its value, ties included, come as near to ``share`` as the
    sketch promises, give or take one row; a distinct estimate if it is off by 5 % and one at most.
    """
    c = S.cents(F.abs("amount"))
    wanted = merged.select(A, S.cents(F.col(q)).alias("_at"))
    rows = txn.select(A, c.alias("_c"), "counterparty_id")
    sizes = txn.groupBy(A).agg(F.count(F.lit(1)).alias("n"))
    ranked = lookup_by_key(rows, sizes.join(wanted, A), A)
    exact = ranked.groupBy(A).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_c") < F.col("_at")).alias("_below"), F.count_if(F.col("_c") <= F.col("_at")).alias("_upto"),
        F.count_distinct("counterparty_id").alias("_cps"),
    )
    slack = SKETCH_ERROR * F.col("_n") + 1
    near = (F.col("_below") - slack <= share * F.col("_n")) & (share * F.col("_n") <= F.col("_upto") + slack)
    close = F.abs(F.col("cp_estimate") - F.col("_cps")) <= 0.05 * F.col("_cps") + 1
    return merged.join(exact, A).withColumns({"median_within_bound": near.cast("int"), "distinct_within_bound": close.cast("int")})


def mcc_global_stats(txn: DataFrame) -> DataFrame:
    """Mean and population std of absolute amounts per merchant category, with its row count."""
    a = F.abs("amount")
    return (
        txn.filter(F.col("mcc_code").isNotNull())
        .groupBy("mcc_code")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mcc_mean"), F.stddev_pop(a).alias("mcc_std"))
    )


def mcc_anomaly(txn: DataFrame, stats: DataFrame, **hot) -> DataFrame:
    """Per-account maximum, mean and tail share of the amount's z-score within its category."""
    rows = lookup_by_key(txn.select(A, "mcc_code", F.abs("amount").alias("a")), stats, "mcc_code", **hot)
    z = F.coalesce((F.col("a") - F.col("mcc_mean")) / F.greatest(F.col("mcc_std"), F.lit(1.0)), F.lit(0.0))
    return rows.select(A, z.alias("z")).groupBy(A).agg(
        F.max("z").alias("mcc_zscore_max"),
        F.avg("z").alias("mcc_zscore_mean"),
        F.count_if(F.col("z") > 2).alias("mcc_zscore_gt2"),
        (F.count_if(F.col("z") > 2) / F.count(F.lit(1))).alias("unusual_mcc_pct"),
    )


def salary_regularity(txn: DataFrame) -> DataFrame:
    """Variation of monthly credit totals and the number of months with credits."""
    monthly = (
        txn.filter(F.col("txn_type") == "C")
        .groupBy(A, F.trunc(F.to_date("ts"), "MM").alias("month"))
        .agg((F.sum(S.cents(F.abs("amount"))) / 100).alias("m"))
    )
    spread = F.coalesce(F.stddev_samp("m"), F.lit(0.0))
    return monthly.groupBy(A).agg(
        (spread / F.greatest(F.avg("m"), F.lit(1.0))).alias("salary_irregularity"), F.count(F.lit(1)).alias("months_with_credits")
    )


def share_counts(dim: DataFrame, columns: dict[str, Sequence[str]], key: str = A, **hot) -> DataFrame:
    """How many rows share each row's value (phone, address); missing values stay missing."""
    out = dim
    for name, parts in columns.items():
        parts = list(parts)
        counts = dim.dropna(subset=parts).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
        out = lookup_by_key(out, counts.withColumn(name, F.col("n")), parts, **hot)
    return out.select(key, *columns)


def code_shares(side: DataFrame) -> DataFrame:
    """Shares of sub-type and part-type codes; 0 for accounts without any code."""
    sub, part = F.col("transaction_sub_type"), F.col("part_transaction_type")

    def share(c: Column, code: str) -> Column:
        return F.count_if(c == code) / F.greatest(F.count(c), F.lit(1))

    return side.groupBy(A).agg(
        share(sub, "CLT_CASH").alias("cash_txn_pct"),
        share(sub, "LOAN").alias("loan_txn_pct"),
        share(part, "CI").alias("customer_induced_pct"),
        share(part, "BI").alias("bank_induced_pct"),
    )


def code_pivot(side: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Counts of a fixed code list as columns."""
    return side.groupBy(A).pivot(column, list(codes)).agg(F.count(F.lit(1))).fillna(0)


def ip_diversity(side: DataFrame) -> DataFrame:
    return side.groupBy(A).agg(
        F.count_distinct("ip_address").alias("unique_ip_count"),
        (F.count_distinct("ip_address") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ip_per_txn"),
    )


def geo_spread(side: DataFrame) -> DataFrame:
    """Extent of known coordinates (missing below two points), grid cells, total extent."""
    lat, lon = F.col("latitude"), F.col("longitude")
    known = lat.isNotNull() & lon.isNotNull()

    def extent(c: Column) -> Column:
        seen = F.when(known, c)
        return F.when(F.count(seen) >= 2, F.max(seen) - F.min(seen))

    out = side.groupBy(A).agg(
        extent(lat).alias("geo_spread_lat"),
        extent(lon).alias("geo_spread_lon"),
        F.count_distinct(S.rounded_location(lat, lon)).alias("geo_unique_locations"),
    )
    return out.withColumn("geo_spread_total", F.abs("geo_spread_lat") + F.abs("geo_spread_lon"))


def balance_dynamics(side: DataFrame, order: Sequence[str] = ("ts", "transaction_id"), **hot) -> DataFrame:
    """Mean, std and minimum of balances and how often the sign changes; needs three balances."""
    b = F.col("balance_after_transaction")
    known = side.filter(b.isNotNull()).select(A, *order, b.alias("b"))
    rows = with_neighbours(known, {"prev": ("b", 1)}, order=order, **hot)
    crossed = F.count_if(F.col("prev").isNotNull() & (F.signum("b") != F.signum("prev")))
    stats = rows.groupBy(A).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("b").alias("balance_mean"), F.stddev_samp("b").alias("balance_std"), F.min("b").alias("balance_min"), crossed.alias("zero_crossings")
    )
    return stats.select(A, *[F.when(F.col("_n") >= 3, F.col(c)).alias(c) for c in stats.columns if c not in (A, "_n")])


def residual(accounts: DataFrame, volumes: DataFrame, tiny: float = 0.001) -> DataFrame:
    """Resting balance relative to the volume moved through the account."""
    joined = accounts.select(A, "daily_avg_balance").join(volumes.select(A, "total_volume"), A, "left")
    return joined.select(A, residual_ratio().alias("residual_ratio")).withColumn("is_tiny_residual", F.coalesce((F.col("residual_ratio") < tiny).cast("int"), F.lit(0)))


def residual_ratio() -> Column:
    """Resting balance over moved volume, from ``daily_avg_balance`` and ``total_volume``."""
    return S.safe_ratio(F.abs("daily_avg_balance"), "total_volume")


def account_flags(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        A,
        S.flag_present("freeze_date").alias("has_prior_freeze"),
        S.flag_present("unfreeze_date").alias("has_unfreeze"),
        S.flag_eq("account_status", "frozen").alias("is_frozen"),
        S.flag_present("last_mobile_update_date").alias("has_mobile_update"),
    )


def customer_bridge(dim: DataFrame, linkage: DataFrame, how: str = "inner") -> DataFrame:
    """Customer-level rows on account level through the linkage table."""
    return linkage.select("customer_id", A).join(dim, "customer_id", how)


def kyc_flags(customers: DataFrame, linkage: DataFrame) -> DataFrame:
    """``aadhaar_missing`` per account: 1 when the document is not marked available."""
    joined = customer_bridge(customers.select("customer_id", "aadhaar_available"), linkage, "left")
    return joined.select(A, (1 - S.flag_eq("aadhaar_available", "Y")).alias("aadhaar_missing"))


def account_age(accounts: DataFrame, as_of: str, missing: int = 9999) -> DataFrame:
    """Days since KYC and opening at a fixed date."""
    age = lambda c: F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col(c)), F.lit(missing))
    return accounts.select(A, age("last_kyc_date").alias("kyc_age_days"), age("opening_date").alias("account_age_days"))


def balance_ratios(accounts: DataFrame, ages: DataFrame, volumes: DataFrame) -> DataFrame:
    b = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    joined = accounts.join(ages, A).join(volumes.select(A, "total_volume"), A, "left")
    return joined.select(
        A,
        S.safe_ratio(F.abs(b("monthly_avg_balance") - b("quarterly_avg_balance")), F.abs(b("quarterly_avg_balance"))).alias("balance_volatility"),
        S.safe_ratio(b("daily_avg_balance"), F.abs(b("avg_balance"))).alias("balance_daily_ratio"),
        S.safe_ratio(b("total_volume"), "account_age_days").alias("volume_per_day"),
    )


def branch_profile(accounts: DataFrame, branch: DataFrame, **hot) -> DataFrame:
    """Branch type flags and size columns (numeric text is parsed) by branch code."""
    sizes = ["branch_employee_count", "branch_turnover", "branch_asset_size"]
    numeric = branch.select("branch_code", "branch_type", *[F.col(c).try_cast("double").alias(c) for c in sizes])
    per_branch = accounts.groupBy("branch_code").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_by_key(accounts.select(A, "branch_code"), numeric, "branch_code", counts=per_branch, **hot)
    return joined.select(A, S.flag_eq("branch_type", "urban").alias("is_urban"), S.flag_eq("branch_type", "rural").alias("is_rural"), *sizes)


def demographic_flags(demographics: DataFrame, linkage: DataFrame) -> DataFrame:
    joined = customer_bridge(demographics, linkage)
    return joined.select(
        A,
        S.flag_eq("joint_account_flag", "Y").alias("is_joint"),
        S.flag_eq("nri_flag", "Y").alias("is_nri"),
        S.flag_eq("gender", "M").alias("is_male"),
    )


def daily_series(txn: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(account, day_no, volume in cents, count): the bounded base of all window operators."""
    rows = txn if ids is None else txn.join(ids.select(A), A, "left_semi")
    return rows.groupBy(A, F.unix_date(F.to_date("ts")).cast("bigint").alias("day_no")).agg(
        F.sum(S.cents(F.abs("amount"))).alias("v"), F.count(F.lit(1)).alias("n")
    )


def ks_phase_shift(daily: DataFrame, min_days: int = 7) -> DataFrame:
    """Two-sample KS distance between the earlier and the later half of the daily volumes."""
    account = Window.partitionBy(A)
    by_day = account.orderBy("day_no")
    up_to = account.orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    halves = daily.withColumns({"_rn": F.row_number().over(by_day), "_n": F.count(F.lit(1)).over(account)}).filter(F.col("_n") >= min_days)
    size1 = F.floor(F.col("_n") / 2)
    early = (F.col("_rn") <= size1).cast("int")
    gap = F.abs(F.sum(early).over(up_to) / size1 - F.sum(1 - early).over(up_to) / (F.col("_n") - size1))
    return halves.withColumn("_gap", gap).groupBy(A).agg(F.max("_gap").alias("ks_phase_shift"))


def volume_concentration(daily: DataFrame) -> DataFrame:
    """Largest 7-day volume and the share of the largest 30-day volume."""
    from ledgersignal.operators.windows import range_sum

    both = range_sum(range_sum(daily, 6, "w7"), 29, "w30")
    return both.groupBy(A).agg((F.max("w7") / 100).alias("velocity_7d_max"), (F.max("w30") / F.greatest(F.sum("v"), F.lit(1))).alias("vol_concentration_30d"))


def credit_debit_symmetry(flows: DataFrame) -> DataFrame:
    c, d = F.col("credit_volume"), F.col("debit_volume")
    return flows.select(A, (F.least(c, d) / F.greatest(c, d, F.lit(1.0))).alias("credit_debit_symmetry"))
