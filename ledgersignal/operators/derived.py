"""Features computed from the account feature table: ratios, products, signals, composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.functions.scalars import clip, safe_ratio, total_of
from ledgersignal.operators.ranking import attach_row, quantile_row, rank_columns

A = "account_id"

# Alert reasons and the pattern code each stands for.
ALERT_PATTERNS = {
    "Dormant Account Reactivation": "dormant",
    "Structuring Transactions Below Threshold": "structuring",
    "Rapid Movement of Funds": "rapid_passthrough",
    "Unusual Fund Flow Pattern": "fan_in_out",
    "Geographic Anomaly Detected": "geo_anomaly",
    "High-Value Activity on New Account": "new_high_value",
    "Income-Transaction Mismatch": "income_mismatch",
    "Post-Contact-Update Spike": "post_mobile",
    "Round Amount Pattern": "round_amounts",
    "Layered Transaction Pattern": "layered",
    "Salary Cycle Anomaly": "salary",
    "Branch Cluster Investigation": "branch_cluster",
    "MCC-Amount Distribution Anomaly": "mcc_anomaly",
    "Routine Investigation": "routine",
}

# The column sets of the composite scores.
COMPOSITE_V1 = ("near_threshold_pct", "round_amount_pct", "gap_cv", "degree_centrality", "mule_trigram_count", "branch_mule_rate", "has_prior_freeze", "mcc_entropy")
COMPOSITE_OOF = ("near_threshold_pct", "round_amount_pct", "gap_cv", "degree_centrality", "mule_trigram_count", "branch_mule_rate_oof", "has_prior_freeze")
COMPOSITE_V6 = ("near_threshold_pct", "round_amount_pct", "gap_cv", "degree_centrality", "branch_mule_rate_oof", "has_prior_freeze")

# The twelve behavioural signals in their order.
SIGNALS = (
    "sig_dormant", "sig_structuring", "sig_rapid", "sig_fanout", "sig_new_highvol", "sig_round",
    "sig_post_mobile", "sig_income_mismatch", "sig_branch_cluster", "sig_residual", "sig_geo", "sig_freeze",
)
SIGNALS_V7 = SIGNALS[:9]


def c(name: str) -> Column:
    return F.col(name)


def interactions_h42(feat: DataFrame) -> DataFrame:
    return feat.withColumns(
        {
            "degree_x_night": c("degree_centrality") * c("night_txn_pct"),
            "gapcv_x_degree": c("gap_cv") * c("degree_centrality"),
            "gapcv_x_near50k": c("gap_cv") * c("near_threshold_pct"),
            "degree_x_near50k": c("degree_centrality") * c("near_threshold_pct"),
        }
    )


def composite_score(feat: DataFrame, columns: Sequence[str], reference: DataFrame | None = None, name: str = "composite_score") -> DataFrame:
    """Sum of z-scores with the reference rows' mean and sample std.

    Missing values count as the mean; a column without spread adds nothing. The statistics are one
    row, read through a scalar subquery.
    """
    reference = feat if reference is None else reference
    stats = reference.agg(*[F.avg(x).alias(f"_m_{x}") for x in columns], *[F.stddev_samp(x).alias(f"_s_{x}") for x in columns])
    z = [F.when(c(f"_s_{x}") > 0, (F.coalesce(c(x), c(f"_m_{x}")) - c(f"_m_{x}")) / c(f"_s_{x}")).otherwise(F.lit(0.0)) for x in columns]
    return attach_row(feat, stats).withColumn(name, total_of(z)).drop(*stats.columns)


def ratio_features(feat: DataFrame) -> DataFrame:
    return feat.withColumns(
        {
            "in_out_vol_ratio": safe_ratio("credit_volume", "debit_volume"),
            "net_flow": c("credit_volume") - c("debit_volume"),
            "pass_through_ratio": F.abs(c("credit_volume") - c("debit_volume")) / (c("credit_volume") + c("debit_volume") + 1),
            "in_out_cp_ratio": safe_ratio("credit_cp_n", "debit_cp_n"),
            "unique_recv_ratio": safe_ratio("degree_centrality", "txn_count"),
            "txn_per_cp": safe_ratio("txn_count", "degree_centrality"),
        }
    )


def velocity_burst(feat: DataFrame) -> DataFrame:
    days = F.greatest(c("active_days"), F.lit(1))
    out = feat.withColumns(
        {
            "txn_velocity": c("txn_count") / days,
            "txn_per_week": c("txn_count") / (days / 7),
            "gap_cv_v10": safe_ratio("gap_std", "gap_mean"),
            "night_burst": safe_ratio("night_count", "txn_count"),
            "structure_intensity": safe_ratio("near_threshold_count", "txn_count"),
            "mean_amount": safe_ratio("total_volume", "txn_count"),
            "cv_amount": safe_ratio("amt_std", "amt_mean"),
            "max_to_total": safe_ratio("amt_max", "total_volume"),
            "balance_range": clip("amt_max", 0.0) - c("balance_min"),
        }
    )
    return out.withColumn("burst_score", c("gap_cv_v10") * c("txn_velocity"))


def v10_interactions(feat: DataFrame) -> DataFrame:
    """Products over the ratio, velocity and signal features."""
    return feat.withColumns(
        {
            "velocity_x_receivers": c("txn_velocity") * c("unique_recv_ratio"),
            "burst_x_structuring": c("burst_score") * c("near_threshold_pct"),
            "ratio_x_trigram": c("in_out_vol_ratio") * F.coalesce(c("mule_trigram_count"), F.lit(0)),
            "velocity_x_branch": c("txn_velocity") * c("branch_mule_rate_oof"),
            "receivers_x_round": c("unique_recv_ratio") * c("round_amount_pct"),
            "signals_x_velocity": c("multi_signal_count") * c("txn_velocity"),
            "consistency_x_burst": c("signal_consistency") * c("burst_score"),
        }
    )


def derivatives(feat: DataFrame) -> DataFrame:
    """Per-active-day rates and their second order."""
    days = F.greatest(c("active_days"), F.lit(1))
    rates = {
        "vol_derivative": c("total_volume"),
        "vol_acceleration": c("total_volume") / days,
        "txn_acceleration": c("txn_count") / days,
        "credit_derivative": c("credit_volume"),
        "debit_derivative": c("debit_volume"),
        "net_flow_derivative": c("credit_volume") - c("debit_volume"),
        "cp_networking_derivative": c("degree_centrality"),
        "balance_volatility_derivative": c("balance_std"),
        "amt_mean_derivative": c("amt_mean"),
        "burstiness_derivative": c("gap_cv"),
    }
    out = feat.withColumns({name: value / days for name, value in rates.items()})
    return out.withColumn("vol_per_txn_derivative", safe_ratio("vol_derivative", "txn_count"))


def burner_velocity(feat: DataFrame) -> DataFrame:
    per_day = c("total_volume") / F.greatest(c("active_days"), F.lit(1))
    return feat.withColumns(
        {
            "time_to_zero_proxy": F.coalesce(c("median_dwell_hours"), F.lit(9999.0)),
            "fast_drain": F.coalesce((c("median_dwell_hours") < 24).cast("int"), F.lit(0)),
            "post_mobile_volume_proxy": c("has_mobile_update") * per_day,
            "volume_velocity": per_day,
            "drain_ratio": safe_ratio(F.abs(c("balance_min")), "total_volume"),
            "structuring_drain": c("near_threshold_pct") * c("total_volume"),
            "volume_per_day_life": safe_ratio("total_volume", "days_to_first_large"),
        }
    )


def combo_features_v6(feat: DataFrame) -> DataFrame:
    """Products that need two weak signs together."""
    moving = 1.0 - clip("residual_ratio", 0.0, 1.0)
    timing = clip("gap_cv", 0.0, 10.0)
    degree = c("degree_centrality")
    return feat.withColumns(
        {
            "freeze_x_degree": c("has_prior_freeze") * degree,
            "freeze_x_passthru": c("has_prior_freeze") * moving,
            "freeze_x_gapcv": c("has_prior_freeze") * timing,
            "struct_x_degree": c("near_threshold_pct") * degree,
            "struct_x_gapcv": c("near_threshold_pct") * timing,
            "passthru_x_degree": moving * degree,
            "passthru_x_logvol": moving * F.log1p(c("total_volume")),
            "night_x_degree": c("night_txn_pct") * degree,
            "round_x_struct": c("round_amount_pct") * c("near_threshold_pct"),
            "liferatio_x_degree": c("life_ratio") * degree,
            "geo_x_degree": (F.abs(c("geo_spread_lat")) + F.abs(c("geo_spread_lon"))) * degree,
        }
    )


def cross_v9(feat: DataFrame) -> DataFrame:
    return feat.withColumns(
        {
            "gapcv_x_degree_v2": c("gap_cv") * c("degree_centrality"),
            "signal_x_branch": c("multi_signal_count") * c("branch_mule_rate_oof"),
            "consistency_x_tri": c("signal_consistency") * F.coalesce(c("mule_trigram_count"), F.lit(0)),
            "txn_intensity": safe_ratio("txn_count", "active_days"),
            "avg_txn_size": safe_ratio("total_volume", "txn_count"),
        }
    )


def _volume_to_balance() -> Column:
    return safe_ratio("total_volume", F.abs(c("balance_mean")))


def _geo() -> Column:
    return F.coalesce(c("geo_spread_lat"), F.lit(0.0)) + F.coalesce(c("geo_spread_lon"), F.lit(0.0))


def signal_thresholds(train: DataFrame) -> DataFrame:
    """One row of exact training quantiles used by the signals."""
    return quantile_row(
        train,
        {
            "q90_near": (c("near_threshold_pct"), 0.90),
            "q90_round": (c("round_amount_pct"), 0.90),
            "q75_vol": (c("total_volume"), 0.75),
            "q90_branch": (c("branch_mule_rate_oof"), 0.90),
            "q90_vtob": (_volume_to_balance(), 0.90),
            "q90_geo": (_geo(), 0.90),
        },
    )


def signals(feat: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Twelve 0/1 signals against training thresholds; comparisons with missing values are 0."""
    rules = {
        "sig_dormant": c("days_to_first_large") > 180,
        "sig_structuring": c("near_threshold_pct") > c("q90_near"),
        "sig_rapid": c("median_dwell_hours") < 24,
        "sig_fanout": safe_ratio("degree_centrality", "txn_count") > 0.5,
        "sig_new_highvol": (c("days_to_first_large") < 30) & (c("total_volume") > c("q75_vol")),
        "sig_round": c("round_amount_pct") > c("q90_round"),
        "sig_post_mobile": c("has_mobile_update") == 1,
        "sig_income_mismatch": _volume_to_balance() > c("q90_vtob"),
        "sig_branch_cluster": c("branch_mule_rate_oof") > c("q90_branch"),
        "sig_residual": c("residual_ratio") < 0.01,
        "sig_geo": _geo() > c("q90_geo"),
        "sig_freeze": c("has_prior_freeze") == 1,
    }
    flagged = attach_row(feat, thresholds)
    return flagged.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in rules.items()}).drop(*thresholds.columns)


def signal_summary(flags: DataFrame, names: Sequence[str] = SIGNALS, saturation: float = 0.75) -> DataFrame:
    """Count, consistency, population variance, mean binary entropy and saturation of signals."""
    n = len(names)
    strength = [c(s).cast("double") for s in names]
    mean = total_of(strength) / n
    p = [F.least(F.greatest(s, F.lit(1e-9)), F.lit(1 - 1e-9)) for s in strength]
    binary = [-(x * F.log(x) + (1 - x) * F.log(1 - x)) for x in p]
    out = flags.withColumns(
        {
            "multi_signal_count": total_of(strength),
            "signal_consistency": mean,
            "signal_variance": total_of([(s - mean) * (s - mean) for s in strength]) / n,
            "signal_entropy": total_of(binary) / n,
        }
    )
    out = out.withColumns(
        {
            "multi_signal_binary": (c("multi_signal_count") >= 3).cast("int"),
            "signal_saturation": (c("multi_signal_count") >= n * saturation).cast("int"),
        }
    )
    return out.withColumn("too_perfect_score", c("signal_entropy") * c("signal_saturation"))


def lean_signals(feat: DataFrame) -> DataFrame:
    """Percentile-rank strengths per account and four summaries of them."""
    ranked = {
        "days_to_first_large": c("days_to_first_large"),
        "near_threshold_pct": c("near_threshold_pct"),
        "median_dwell_hours": c("median_dwell_hours"),
        "round_amount_pct": c("round_amount_pct"),
        "degree_centrality": c("degree_centrality"),
        "branch_mule_rate_oof": c("branch_mule_rate_oof"),
    }
    ranks = rank_columns(feat, A, ranked)
    joined = ranks.join(feat.select(A, "has_mobile_update"), A)
    strength = [1 - c(f"{x}_rank") if x == "median_dwell_hours" else c(f"{x}_rank") for x in ranked]
    strength.append(F.coalesce(c("has_mobile_update").cast("double"), F.lit(0.0)))
    n = len(strength)
    mean = total_of(strength) / n
    return joined.select(
        A,
        total_of([(s > 0.75).cast("int") for s in strength]).alias("signal_count_above_p75"),
        (total_of([(s - mean) * (s - mean) for s in strength]) / n).alias("signal_variance"),
        F.greatest(*strength).alias("signal_max_strength"),
        mean.alias("signal_mean_strength"),
    )


def error_features(feat: DataFrame) -> DataFrame:
    return feat.withColumns(
        {
            "fp_risk_score": c("txn_velocity") / (c("signal_entropy") + 0.01),
            "fn_subtle_score": c("signal_consistency") * (1 - c("signal_variance")),
            "night_structure": c("night_burst") * c("near_threshold_pct"),
            "passthrough_x_receivers": c("pass_through_ratio") * c("unique_recv_ratio"),
        }
    )


def alert_taxonomy(labels: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rows per alert pattern, patterns with more than ``min_rows`` only."""
    mapping = F.create_map(*[F.lit(x) for pair in ALERT_PATTERNS.items() for x in pair])
    coded = labels.select(mapping[c("alert_reason")].alias("pattern")).filter(c("pattern").isNotNull())
    return coded.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_rows")).filter(c("n_rows") > min_rows)
