"""Queries over target encodings, derived features and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgersignal.operators import derived as DE
from ledgersignal.operators import encode as EN
from ledgersignal.operators import evaluate as EV
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.bank_features import numeric_features
from ledgersignal.plans.feature_table import ALL_GROUPS, encoded_labels, features, signal_table, stored_features
from ledgersignal.plans.registry import query
from ledgersignal.sources import adapters as AD

A = "account_id"
W = O.with_


# ---- target encoding and folds -------------------------------------------------------------

@query("target_encode", i="account_id", d="branch_mule_rate", sql=W("SELECT account_id, branch_mule_rate FROM oof", O.LABELS, O.ENCODE))
def _(spark, sf):
    labels = AD.labels(spark, sf)
    return EN.target_encode(labels.filter(~F.col("is_test")), labels, "branch_code", "is_mule", name="branch_mule_rate")


@query("target_encode_oof", i="account_id", d="branch_mule_rate_oof", sql=W("SELECT account_id, branch_mule_rate_oof FROM oof", O.LABELS, O.ENCODE))
def _(spark, sf):
    return encoded_labels(AD.labels(spark, sf))


TIME_FOLDS = """tf AS (SELECT *, (time_rank - 1) // (SELECT count(*) // 6 FROM labels_t) AS bucket FROM (
  SELECT account_id, branch_code, is_mule, row_number() OVER (ORDER BY opening_date NULLS LAST, account_id) AS time_rank FROM labels_t JOIN accounts USING (account_id, branch_code)))"""


def time_foldered(spark, sf):
    labels = AD.labels(spark, sf).select(A, "is_mule", "branch_code")
    dated = labels.join(AD.accounts(spark, sf).select(A, "opening_date"), A)
    return EN.time_folds(dated, "opening_date", 5)


@query("time_rank", i="account_id time_rank", sql=W("SELECT account_id, time_rank FROM tf", O.ACCOUNTS, O.LABELS, TIME_FOLDS))
def _(spark, sf):
    return EN.time_rank(AD.accounts(spark, sf), "opening_date")


@query("time_folds", i="account_id time_rank bucket", sql=W("SELECT account_id, time_rank, bucket FROM tf", O.ACCOUNTS, O.LABELS, TIME_FOLDS))
def _(spark, sf):
    return time_foldered(spark, sf)


@query("target_encode_expanding", i="account_id bucket", d="rate_time", sql=W("""
  SELECT account_id, bucket, CASE WHEN bucket BETWEEN 1 AND 5 THEN (coalesce((SELECT sum(is_mule) FROM tf b WHERE b.branch_code = a.branch_code AND b.bucket < a.bucket), 0) + 10 * (SELECT avg(is_mule) FROM tf))
    / (coalesce((SELECT count(*) FROM tf b WHERE b.branch_code = a.branch_code AND b.bucket < a.bucket), 0) + 10) ELSE (SELECT avg(is_mule) FROM tf) END AS rate_time FROM tf a""", O.ACCOUNTS, O.LABELS, TIME_FOLDS))
def _(spark, sf):
    return EN.target_encode_expanding(time_foldered(spark, sf), "branch_code", "is_mule", "bucket", 5)


@query("stratified_folds", i="account_id fold", sql=W("SELECT account_id, fold FROM labels_t", O.LABELS))
def _(spark, sf):
    return EN.stratified_folds(AD.labels(spark, sf), 5)


@query("usable_folds", i="fold n_train n_valid n_pos", sql=W("""
  SELECT * FROM (SELECT f AS fold, count(*) FILTER (bucket < f) AS n_train, count(*) FILTER (bucket = f) AS n_valid, coalesce(sum(is_mule) FILTER (bucket < f), 0) AS n_pos
  FROM tf, (SELECT unnest([1, 2, 3, 4, 5]) AS f) GROUP BY f) WHERE n_pos > 0 AND n_pos < n_train""", O.ACCOUNTS, O.LABELS, TIME_FOLDS))
def _(spark, sf):
    return EN.usable_folds(time_foldered(spark, sf), "is_mule", "bucket", 5)


# ---- derived features ----------------------------------------------------------------------

@query("interactions", i="account_id", d="degree_x_night gapcv_x_degree gapcv_x_near50k degree_x_near50k", sql=W("""
  SELECT account_id, degree_centrality * night_txn_pct AS degree_x_night, gap_cv * degree_centrality AS gapcv_x_degree, gap_cv * near_threshold_pct AS gapcv_x_near50k, degree_centrality * near_threshold_pct AS degree_x_near50k FROM feat""", *O.feature_ctes("behaviour", "distinct", "gaps")))
def _(spark, sf):
    return DE.interactions_h42(features(spark, sf, ("behaviour", "distinct", "gaps")))


def composite_sql(columns, groups):
    z = lambda c: f"coalesce((coalesce({c}, (SELECT avg({c}) FROM tr)) - (SELECT avg({c}) FROM tr)) / nullif((SELECT stddev_samp({c}) FROM tr), 0), 0)"
    return W(f"SELECT account_id, {' + '.join(z(c) for c in columns)} AS composite_score FROM feat", *O.feature_ctes(*groups), "tr AS (SELECT * FROM feat WHERE NOT is_test)")


def composite(columns, groups):
    def build(spark, sf):
        feat = stored_features(spark, sf, groups)
        return DE.composite_score(feat, columns, feat.filter(~F.col("is_test")))

    return build


OOF_GROUPS = ("behaviour", "distinct", "gaps", "trigrams", "flags", "encode")
V6_GROUPS = ("behaviour", "distinct", "gaps", "flags", "encode")
query("composite_score", i="account_id", d="composite_score", sql=composite_sql(DE.COMPOSITE_OOF, OOF_GROUPS))(composite(DE.COMPOSITE_OOF, OOF_GROUPS))
query("composite_score_v6", i="account_id", d="composite_score", sql=composite_sql(DE.COMPOSITE_V6, V6_GROUPS))(composite(DE.COMPOSITE_V6, V6_GROUPS))


@query("ratio_features", i="account_id", d="in_out_vol_ratio net_flow pass_through_ratio in_out_cp_ratio unique_recv_ratio txn_per_cp", sql=W("""
  SELECT account_id, credit_volume / greatest(debit_volume, 1) AS in_out_vol_ratio, credit_volume - debit_volume AS net_flow, abs(credit_volume - debit_volume) / (credit_volume + debit_volume + 1) AS pass_through_ratio,
         credit_cp_n / greatest(debit_cp_n, 1) AS in_out_cp_ratio, degree_centrality / greatest(txn_count, 1) AS unique_recv_ratio, txn_count / greatest(degree_centrality, 1) AS txn_per_cp FROM feat""", *O.feature_ctes("core", "flow", "distinct")))
def _(spark, sf):
    return DE.ratio_features(features(spark, sf, ("core", "flow", "distinct")))


@query("velocity_burst", i="account_id", d="txn_velocity txn_per_week gap_cv_v10 night_burst structure_intensity mean_amount cv_amount max_to_total balance_range burst_score", sql=W("""
  SELECT account_id, txn_count / greatest(active_days, 1) AS txn_velocity, txn_count / (greatest(active_days, 1) / 7) AS txn_per_week, gap_std / greatest(gap_mean, 1) AS gap_cv_v10, night_count / greatest(txn_count, 1) AS night_burst,
         near_threshold_count / greatest(txn_count, 1) AS structure_intensity, total_volume / greatest(txn_count, 1) AS mean_amount, amt_std / greatest(amt_mean, 1) AS cv_amount, amt_max / greatest(total_volume, 1) AS max_to_total,
         greatest(amt_max, 0) - balance_min AS balance_range, gap_std / greatest(gap_mean, 1) * txn_count / greatest(active_days, 1) AS burst_score FROM feat""", *O.feature_ctes("core", "behaviour", "distinct", "gaps", "balance")))
def _(spark, sf):
    return DE.velocity_burst(features(spark, sf, ("core", "behaviour", "distinct", "gaps", "balance")))


@query("v10_interactions", i="account_id", d="velocity_x_receivers burst_x_structuring ratio_x_trigram velocity_x_branch receivers_x_round signals_x_velocity consistency_x_burst", sql=W("""
  SELECT account_id, vel * recv AS velocity_x_receivers, burst * near_threshold_pct AS burst_x_structuring, credit_volume / greatest(debit_volume, 1) * coalesce(mule_trigram_count, 0) AS ratio_x_trigram, vel * branch_mule_rate_oof AS velocity_x_branch,
         recv * round_amount_pct AS receivers_x_round, multi_signal_count * vel AS signals_x_velocity, signal_consistency * burst AS consistency_x_burst
  FROM (SELECT *, txn_count / greatest(active_days, 1) AS vel, degree_centrality / greatest(txn_count, 1) AS recv, gap_std / greatest(gap_mean, 1) * txn_count / greatest(active_days, 1) AS burst FROM summ)""",
    *O.feature_ctes(*O.SIGNAL_GROUPS, "flow", "gaps", "trigrams"), O.SIGNAL_THRESHOLDS, O.SIGNALS, O.SIGNAL_SUMMARY))
def _(spark, sf):
    table = signal_table(spark, sf, ("flow", "gaps", "trigrams"))
    return DE.v10_interactions(DE.velocity_burst(DE.ratio_features(table)))


@query("derivatives", i="account_id", d="vol_derivative vol_acceleration txn_acceleration credit_derivative debit_derivative net_flow_derivative cp_networking_derivative balance_volatility_derivative amt_mean_derivative burstiness_derivative vol_per_txn_derivative", sql=W("""
  SELECT account_id, total_volume / days AS vol_derivative, total_volume / days / days AS vol_acceleration, txn_count / days / days AS txn_acceleration, credit_volume / days AS credit_derivative, debit_volume / days AS debit_derivative,
         (credit_volume - debit_volume) / days AS net_flow_derivative, degree_centrality / days AS cp_networking_derivative, balance_std / days AS balance_volatility_derivative, amt_mean / days AS amt_mean_derivative, gap_cv / days AS burstiness_derivative,
         total_volume / days / greatest(txn_count, 1) AS vol_per_txn_derivative FROM (SELECT *, greatest(active_days, 1) AS days FROM feat)""", *O.feature_ctes("core", "flow", "distinct", "gaps", "balance")))
def _(spark, sf):
    return DE.derivatives(features(spark, sf, ("core", "flow", "distinct", "gaps", "balance")))


@query("burner_velocity", i="account_id fast_drain", d="time_to_zero_proxy post_mobile_volume_proxy volume_velocity drain_ratio structuring_drain volume_per_day_life", sql=W("""
  SELECT account_id, CAST(coalesce(median_dwell_hours < 24, false) AS INT) AS fast_drain, coalesce(median_dwell_hours, 9999) AS time_to_zero_proxy, has_mobile_update * total_volume / greatest(active_days, 1) AS post_mobile_volume_proxy,
         total_volume / greatest(active_days, 1) AS volume_velocity, abs(balance_min) / CASE WHEN total_volume IS NOT NULL THEN greatest(total_volume, 1) END AS drain_ratio, near_threshold_pct * total_volume AS structuring_drain,
         total_volume / CASE WHEN days_to_first_large IS NOT NULL THEN greatest(days_to_first_large, 1) END AS volume_per_day_life FROM feat""", *O.feature_ctes("core", "behaviour", "distinct", "dwell", "life", "balance", "flags")))
def _(spark, sf):
    return DE.burner_velocity(features(spark, sf, ("core", "behaviour", "distinct", "dwell", "life", "balance", "flags")))


@query("combo_features_v6", i="account_id", d="freeze_x_degree freeze_x_passthru freeze_x_gapcv struct_x_degree struct_x_gapcv passthru_x_degree passthru_x_logvol night_x_degree round_x_struct liferatio_x_degree geo_x_degree", sql=W("""
  SELECT account_id, has_prior_freeze * degree_centrality AS freeze_x_degree, has_prior_freeze * mv AS freeze_x_passthru, has_prior_freeze * tm AS freeze_x_gapcv, near_threshold_pct * degree_centrality AS struct_x_degree, near_threshold_pct * tm AS struct_x_gapcv,
         mv * degree_centrality AS passthru_x_degree, mv * ln(1 + total_volume) AS passthru_x_logvol, night_txn_pct * degree_centrality AS night_x_degree, round_amount_pct * near_threshold_pct AS round_x_struct, life_ratio * degree_centrality AS liferatio_x_degree,
         (abs(geo_spread_lat) + abs(geo_spread_lon)) * degree_centrality AS geo_x_degree
  FROM (SELECT *, 1 - CASE WHEN residual_ratio IS NOT NULL THEN least(greatest(residual_ratio, 0), 1) END AS mv, CASE WHEN gap_cv IS NOT NULL THEN least(greatest(gap_cv, 0), 10) END AS tm FROM feat)""", *O.feature_ctes("core", "behaviour", "distinct", "gaps", "geo", "residual", "flags")))
def _(spark, sf):
    return DE.combo_features_v6(features(spark, sf, ("core", "behaviour", "distinct", "gaps", "geo", "residual", "flags")))


@query("cross_v9", i="account_id", d="gapcv_x_degree_v2 signal_x_branch consistency_x_tri txn_intensity avg_txn_size", sql=W("""
  SELECT account_id, gap_cv * degree_centrality AS gapcv_x_degree_v2, multi_signal_count * branch_mule_rate_oof AS signal_x_branch, signal_consistency * coalesce(mule_trigram_count, 0) AS consistency_x_tri,
         txn_count / greatest(active_days, 1) AS txn_intensity, total_volume / greatest(txn_count, 1) AS avg_txn_size FROM summ""", *O.feature_ctes(*O.SIGNAL_GROUPS, "gaps", "trigrams"), O.SIGNAL_THRESHOLDS, O.SIGNALS, O.SIGNAL_SUMMARY))
def _(spark, sf):
    return DE.cross_v9(signal_table(spark, sf, ("gaps", "trigrams")))


THRESHOLD_COLUMNS = "q90_near q90_round q75_vol q90_branch q90_vtob q90_geo"
THRESHOLD_GROUPS = ("core", "behaviour", "balance", "geo", "encode")


@query("signal_thresholds", d=THRESHOLD_COLUMNS, sql=W("SELECT * FROM thr", *O.feature_ctes(*THRESHOLD_GROUPS), O.SIGNAL_THRESHOLDS))
def _(spark, sf):
    return DE.signal_thresholds(stored_features(spark, sf, THRESHOLD_GROUPS).filter(~F.col("is_test")))


@query("signals", i="account_id " + " ".join(DE.SIGNALS), sql=W("SELECT * FROM sig", *O.feature_ctes(*O.SIGNAL_GROUPS), O.SIGNAL_THRESHOLDS, O.SIGNALS))
def _(spark, sf):
    return signal_table(spark, sf)


@query("signal_summary", i="account_id multi_signal_count multi_signal_binary signal_saturation", d="signal_consistency signal_variance signal_entropy too_perfect_score", sql=W("SELECT * FROM summ", *O.feature_ctes(*O.SIGNAL_GROUPS), O.SIGNAL_THRESHOLDS, O.SIGNALS, O.SIGNAL_SUMMARY))
def _(spark, sf):
    return signal_table(spark, sf)


def _lean_sql():
    rank = lambda c: f"coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END, 0.5)"
    names = ("days_to_first_large", "near_threshold_pct", "median_dwell_hours", "round_amount_pct", "degree_centrality", "branch_mule_rate_oof")
    parts = [f"{'1 - ' if c == 'median_dwell_hours' else ''}{rank(c)} AS s{i}" for i, c in enumerate(names)] + ["coalesce(has_mobile_update, 0) AS s6"]
    s = [f"s{i}" for i in range(7)]
    mean = f"(({' + '.join(s)}) / 7)"
    return W(f"""SELECT account_id, {' + '.join(f'CAST({x} > 0.75 AS INT)' for x in s)} AS signal_count_above_p75, ({' + '.join(f'pow({x} - {mean}, 2)' for x in s)}) / 7 AS signal_variance, greatest({', '.join(s)}) AS signal_max_strength, {mean} AS signal_mean_strength
      FROM (SELECT account_id, {', '.join(parts)} FROM feat)""", *O.feature_ctes("behaviour", "distinct", "dwell", "life", "flags", "encode"))


@query("lean_signals", i="account_id signal_count_above_p75", d="signal_variance signal_max_strength signal_mean_strength", sql=_lean_sql())
def _(spark, sf):
    return DE.lean_signals(stored_features(spark, sf, ("behaviour", "distinct", "dwell", "life", "flags", "encode")))


@query("error_features", i="account_id", d="fp_risk_score fn_subtle_score night_structure passthrough_x_receivers", sql=W("""
  SELECT account_id, txn_count / greatest(active_days, 1) / (signal_entropy + 0.01) AS fp_risk_score, signal_consistency * (1 - signal_variance) AS fn_subtle_score, night_count / greatest(txn_count, 1) * near_threshold_pct AS night_structure,
         abs(credit_volume - debit_volume) / (credit_volume + debit_volume + 1) * degree_centrality / greatest(txn_count, 1) AS passthrough_x_receivers FROM summ""", *O.feature_ctes(*O.SIGNAL_GROUPS, "flow", "gaps"), O.SIGNAL_THRESHOLDS, O.SIGNALS, O.SIGNAL_SUMMARY))
def _(spark, sf):
    table = signal_table(spark, sf, ("flow", "gaps"))
    return DE.error_features(DE.velocity_burst(DE.ratio_features(table)))


REASONS = list(DE.ALERT_PATTERNS)


def _taxonomy_sql():
    whens = " ".join(f"WHEN {i} THEN '{DE.ALERT_PATTERNS[r]}'" for i, r in enumerate(REASONS))
    return f"SELECT pattern, count(*) AS n_rows FROM (SELECT CASE c_custkey % 17 {whens} END AS pattern FROM customer) WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) > 10"


@query("alert_taxonomy", i="n_rows", s="pattern", sql=_taxonomy_sql())
def _(spark, sf):
    reasons = F.array(*[F.lit(r) for r in REASONS])
    cust = AD.table(spark, sf, "customer")
    return DE.alert_taxonomy(cust.select(F.try_element_at(reasons, (F.col("c_custkey") % 17 + 1).cast("int")).alias("alert_reason")))


# ---- reports over every feature column -----------------------------------------------------

# Long form of the whole table: all columns but the keys and labels, as in numeric_features.
LONG = """wide AS (SELECT account_id, is_mule AS label, CAST(COLUMNS(* EXCLUDE (account_id, is_mule, is_test, branch_mule_rate, first_large_ts, n)) AS DOUBLE), CAST(geo_spread_lat + geo_spread_lon AS DOUBLE) AS geo_spread_total FROM feat),
long AS (SELECT label, feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(* EXCLUDE (account_id, label)))))"""


def report(name, body, build, **columns):
    @query(name, **columns, s="feature", sql=W(body, *O.feature_ctes(*ALL_GROUPS), LONG))
    def _(spark, sf):
        feat = stored_features(spark, sf)
        return build(feat, numeric_features(feat))


report("feature_quality", """SELECT feature, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS null_share, CAST(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 0.5 AS INT) AS mostly_null,
  CAST(count(value) = count(*) AS INT) AS complete FROM long GROUP BY feature""", EV.feature_quality, i="mostly_null complete", d="null_share")

report("corr_with_target", "SELECT feature, abs(corr(value, label)) AS abs_corr FROM long GROUP BY feature",
    lambda feat, names: EV.corr_with_target(feat, "is_mule", names), d="abs_corr")

report("class_ratio_report", """SELECT *, coalesce(CAST(abs(ratio - 1) > 0.15 AS INT), 1) AS strong FROM (SELECT *, CASE WHEN other_mean > 0 THEN mule_mean / other_mean END AS ratio
  FROM (SELECT feature, avg(value) FILTER (label = 1) AS mule_mean, avg(value) FILTER (label = 0) AS other_mean FROM long GROUP BY feature))""",
    lambda feat, names: EV.class_ratio_report(feat, "is_mule", names), i="strong", d="mule_mean other_mean ratio")

report("describe_features", """SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY feature""", EV.describe, i="n", d="mean std min max p25 p50 p75")
