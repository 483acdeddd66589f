"""Shared SQL fragments (DuckDB dialect): the ledger views and feature groups as CTEs."""

from __future__ import annotations

LEDGER = """ledger AS (
  SELECT o_custkey AS account_id, l_shipdate AS ts, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5,
         CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'D' END AS txn_type, l_extendedprice AS a, CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
         CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END AS amount,
         o_orderpriority AS channel, l_suppkey AS counterparty_id, p_brand AS mcc_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

EVENTS = """ledger AS (
  SELECT user_id AS account_id, ts, event_id AS k1, 0 AS k2, 0 AS k3, 0 AS k4, 0 AS k5,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'C' ELSE 'D' END AS txn_type, value AS a, CAST(round(value * 100) AS BIGINT) AS c,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END AS amount,
         event_type AS channel, CAST(json_extract_string(props, '$.k') AS BIGINT) AS counterparty_id, event_type AS mcc_code
  FROM events)"""

ORDER = "ts, k1, k2, k3, k4, k5"
SEQ = f"WINDOW seq AS (PARTITION BY account_id ORDER BY {ORDER})"

ACCOUNTS = """dates AS (
  SELECT o_custkey AS account_id, min(CAST(o_orderdate AS DATE)) AS opening_date,
         max(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) END) AS freeze_date,
         max(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) END) AS unfreeze_date,
         max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS DATE) END) AS last_mobile_update_date,
         max(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END) AS last_kyc_date,
         min(o_totalprice) AS monthly_avg_balance, max(o_totalprice) AS quarterly_avg_balance
  FROM orders GROUP BY o_custkey),
accounts AS (
  SELECT c_custkey AS account_id, c_nationkey AS branch_code, CASE WHEN c_acctbal < -500 THEN 'frozen' ELSE 'active' END AS account_status,
         c_acctbal AS avg_balance, c_acctbal / 10 AS daily_avg_balance, c_mktsegment AS scheme_code, dates.* EXCLUDE (account_id)
  FROM customer LEFT JOIN dates ON c_custkey = dates.account_id)"""


def bucket(key: str, salt: str, n: int) -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT) % {n}"


LABELS = f"""labels_t AS (
  SELECT c_custkey AS account_id, c_nationkey AS branch_code, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_mule,
         {bucket('c_custkey', 'split', 5)} = 0 AS is_test, {bucket('c_custkey', '42', 5)} AS fold
  FROM customer)"""

SCORES = f"""scores AS (
  SELECT c_custkey AS account_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_mule,
         round(({bucket('c_custkey', 'score', 100000)}) / 100000.0 * 0.65 + CASE WHEN c_acctbal < 0 THEN 0.35 ELSE 0.0 END, 3) AS score
  FROM customer)"""

SIDE = """side AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS account_id, o_orderdate AS ts, o_totalprice - 200000 AS b,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'CLT_CASH' WHEN o_orderpriority = '2-HIGH' THEN 'LOAN' ELSE o_orderpriority END AS sub_type,
         CASE WHEN o_orderstatus = 'O' THEN 'CI' WHEN o_orderstatus = 'F' THEN 'BI' ELSE o_orderstatus END AS part_type,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 10000 END AS lat, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 5000 END AS lon,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 17 AS VARCHAR) END AS ip
  FROM orders)"""

CORE = """core AS (
  SELECT account_id, count(*) AS txn_count, sum(c) / 100 AS total_volume, sum(c) / count(c) / 100 AS amt_mean, stddev_samp(a) AS amt_std, max(a) AS amt_max
  FROM ledger GROUP BY account_id)"""

FLOW = """flow AS (
  SELECT account_id, coalesce(sum(c) FILTER (txn_type = 'C'), 0) / 100 AS credit_volume, coalesce(sum(c) FILTER (txn_type = 'D'), 0) / 100 AS debit_volume
  FROM ledger GROUP BY account_id)"""

BEHAVIOUR = """behaviour AS (
  SELECT *, near_threshold_count / n AS near_threshold_pct, round_count / n AS round_amount_pct, small_count / n AS life_ratio, night_count / n AS night_txn_pct
  FROM (SELECT account_id, count(*) AS n, count(*) FILTER (a >= 45000 AND a < 50000) AS near_threshold_count,
               count(*) FILTER (a IN (1000, 5000, 10000, 50000, 100000)) AS round_count, count(*) FILTER (a < 500) AS small_count,
               count(*) FILTER (hour(ts) < 6) AS night_count
        FROM ledger GROUP BY account_id))"""

DISTINCT = """distinct_c AS (
  SELECT account_id, count(DISTINCT counterparty_id) AS degree_centrality, count(DISTINCT counterparty_id) FILTER (txn_type = 'C') AS credit_cp_n,
         count(DISTINCT counterparty_id) FILTER (txn_type = 'D') AS debit_cp_n, count(DISTINCT mcc_code) AS mcc_nunique,
         count(DISTINCT channel) AS channel_diversity, count(DISTINCT CAST(ts AS DATE)) AS active_days
  FROM ledger GROUP BY account_id)"""

GAPS = f"""gap_rows AS (
  SELECT account_id, ts, k1, (epoch_us(ts) - lag(epoch_us(ts)) OVER seq) / 3.6e9 AS gap_h FROM ledger {SEQ}),
gap_s AS (
  SELECT account_id, CASE WHEN count(gap_h) >= 3 THEN avg(gap_h) END AS gap_mean, CASE WHEN count(gap_h) >= 3 THEN stddev_samp(gap_h) END AS gap_std,
         count(gap_h) AS gap_count, CASE WHEN count(gap_h) >= 3 THEN stddev_samp(gap_h) / greatest(avg(gap_h), 0.01) END AS gap_cv
  FROM gap_rows WHERE gap_h IS NOT NULL GROUP BY account_id)"""


def dwell(minimum: float) -> str:
    return f"""dwell AS (
  SELECT account_id, credit_ts, debit_ts, (epoch_us(debit_ts) - epoch_us(credit_ts)) / 3.6e9 AS dwell_hours
  FROM (SELECT account_id, ts AS credit_ts, txn_type, lead(txn_type) OVER seq AS nt, lead(ts) OVER seq AS debit_ts FROM ledger WHERE a >= {minimum} {SEQ})
  WHERE txn_type = 'C' AND nt = 'D')"""


DWELL = dwell(50000)
DWELL_MEDIAN = "dwell_m AS (SELECT account_id, quantile_cont(dwell_hours, 0.5) AS median_dwell_hours FROM dwell GROUP BY account_id)"

FIRST_LARGE = """first_l AS (
  SELECT account_id, min(ts) AS first_large_ts FROM ledger WHERE a > 50000 GROUP BY account_id),
life AS (
  SELECT accounts.account_id, first_large_ts, floor((epoch_us(first_large_ts) - epoch_us(CAST(opening_date AS TIMESTAMP))) / 86400000000) AS days_to_first_large
  FROM accounts LEFT JOIN first_l USING (account_id))"""

TRIGRAMS = f"""actions AS (
  SELECT account_id, txn_type || '_' || channel AS a0, lead(txn_type || '_' || channel) OVER seq AS a1, lead(txn_type || '_' || channel, 2) OVER seq AS a2
  FROM ledger {SEQ}),
tri AS (
  SELECT account_id, a0 || '|' || a1 || '|' || a2 AS trigram, count(*) AS n FROM actions WHERE a2 IS NOT NULL GROUP BY ALL),
tri_labelled AS (
  SELECT trigram, coalesce(sum(n) FILTER (is_mule = 1), 0) AS mule_count, coalesce(sum(n) FILTER (is_mule = 0), 0) AS legit_count
  FROM tri JOIN labels_t USING (account_id) GROUP BY trigram),
enriched AS (
  SELECT *, (mule_count / (SELECT sum(mule_count) FROM tri_labelled)) / greatest(legit_count / (SELECT sum(legit_count) FROM tri_labelled), 1e-8) AS enrichment
  FROM tri_labelled WHERE mule_count >= 5 ORDER BY enrichment DESC, trigram LIMIT 10),
tri_s AS (
  SELECT account_id, count(*) / sum(n) AS trigram_diversity, coalesce(sum(n) FILTER (trigram IN (SELECT trigram FROM enriched)), 0) AS mule_trigram_count
  FROM tri GROUP BY account_id)"""

BALANCE = """crossings AS (
  SELECT account_id, b, lag(b) OVER (PARTITION BY account_id ORDER BY ts, transaction_id) AS prev FROM side),
balance AS (
  SELECT account_id, avg(b) AS balance_mean, stddev_samp(b) AS balance_std, min(b) AS balance_min,
         count(*) FILTER (prev IS NOT NULL AND sign(b) <> sign(prev)) AS zero_crossings
  FROM crossings GROUP BY account_id HAVING count(*) >= 3)"""

GEO = """geo AS (
  SELECT account_id, CASE WHEN count(*) FILTER (ok) >= 2 THEN max(lat) FILTER (ok) - min(lat) FILTER (ok) END AS geo_spread_lat,
         CASE WHEN count(*) FILTER (ok) >= 2 THEN max(lon) FILTER (ok) - min(lon) FILTER (ok) END AS geo_spread_lon,
         count(DISTINCT CASE WHEN ok THEN (round_even(lat, 3), round_even(lon, 3)) END) AS geo_unique_locations
  FROM (SELECT *, lat IS NOT NULL AND lon IS NOT NULL AS ok FROM side) GROUP BY account_id)"""

RESIDUAL = """resid AS (
  SELECT account_id, abs(daily_avg_balance) / CASE WHEN total_volume IS NULL THEN NULL ELSE greatest(total_volume, 1.0) END AS residual_ratio
  FROM accounts LEFT JOIN core USING (account_id))"""

PRIOR = "(SELECT avg(is_mule) FROM train)"
ENCODE = f"""train AS (SELECT * FROM labels_t WHERE NOT is_test),
by_branch AS (SELECT branch_code, sum(is_mule) AS pos, count(*) AS cnt FROM train GROUP BY branch_code),
by_fold AS (SELECT branch_code, fold, sum(is_mule) AS fpos, count(*) AS fcnt FROM train GROUP BY branch_code, fold),
oof AS (
  SELECT labels_t.account_id,
         CASE WHEN is_test THEN (coalesce(pos, 0) + 10 * {PRIOR}) / (coalesce(cnt, 0) + 10)
              ELSE (pos - fpos + 10 * {PRIOR}) / (cnt - fcnt + 10) END AS branch_mule_rate_oof,
         (coalesce(pos, 0) + 10 * {PRIOR}) / (coalesce(cnt, 0) + 10) AS branch_mule_rate
  FROM labels_t LEFT JOIN by_branch USING (branch_code) LEFT JOIN by_fold USING (branch_code, fold))"""

FLAGS = """flags AS (
  SELECT account_id, CAST(freeze_date IS NOT NULL AS INT) AS has_prior_freeze, CAST(unfreeze_date IS NOT NULL AS INT) AS has_unfreeze,
         CAST(account_status = 'frozen' AS INT) AS is_frozen, CAST(last_mobile_update_date IS NOT NULL AS INT) AS has_mobile_update
  FROM accounts)"""

# Feature groups: CTE text, table name, and the groups each one needs.
GROUPS = {
    "core": (CORE, "core", ()),
    "flow": (FLOW, "flow", ()),
    "behaviour": (BEHAVIOUR, "behaviour", ()),
    "distinct": (DISTINCT, "distinct_c", ()),
    "gaps": (GAPS, "gap_s", ()),
    "dwell": (f"{DWELL}, {DWELL_MEDIAN}", "dwell_m", ()),
    "life": (FIRST_LARGE, "life", ()),
    "trigrams": (TRIGRAMS, "tri_s", ()),
    "balance": (f"{SIDE}, {BALANCE}", "balance", ()),
    "geo": (GEO, "geo", ("balance",)),
    "residual": (RESIDUAL, "resid", ("core",)),
    "flags": (FLAGS, "flags", ()),
    "encode": (ENCODE, "oof", ()),
}


def with_(body: str, *ctes: str) -> str:
    """Prefix CTEs; a body that starts with a comma adds CTEs of its own."""
    return f"WITH {', '.join(ctes)} {body}"


def feature_ctes(*groups: str) -> list[str]:
    """CTEs ending in ``feat``: one row per account with the columns of the groups."""
    wanted: list[str] = []
    for g in groups:
        for need in (*GROUPS[g][2], g):
            if need not in wanted:
                wanted.append(need)
    joins = " ".join(f"LEFT JOIN {GROUPS[g][1]} USING (account_id)" for g in wanted)
    cols = ", ".join(f"{GROUPS[g][1]}.* EXCLUDE (account_id)" for g in wanted)
    feat = f"feat AS (SELECT labels_t.account_id, labels_t.is_mule, labels_t.is_test, {cols} FROM labels_t {joins})"
    return [LEDGER, ACCOUNTS, LABELS, *[GROUPS[g][0] for g in wanted], feat]


SIGNAL_THRESHOLDS = """thr AS (
  SELECT quantile_cont(near_threshold_pct, 0.9) AS q90_near, quantile_cont(round_amount_pct, 0.9) AS q90_round, quantile_cont(total_volume, 0.75) AS q75_vol,
         quantile_cont(branch_mule_rate_oof, 0.9) AS q90_branch, quantile_cont(total_volume / CASE WHEN balance_mean IS NOT NULL THEN greatest(abs(balance_mean), 1) END, 0.9) AS q90_vtob,
         quantile_cont(coalesce(geo_spread_lat, 0) + coalesce(geo_spread_lon, 0), 0.9) AS q90_geo
  FROM feat WHERE NOT is_test)"""

SIGNALS = """sig AS (
  SELECT feat.*, CAST(coalesce(days_to_first_large > 180, false) AS INT) AS sig_dormant,
    CAST(coalesce(near_threshold_pct > q90_near, false) AS INT) AS sig_structuring,
    CAST(coalesce(median_dwell_hours < 24, false) AS INT) AS sig_rapid,
    CAST(coalesce(degree_centrality / greatest(txn_count, 1) > 0.5, false) AS INT) AS sig_fanout,
    CAST(coalesce(days_to_first_large < 30 AND total_volume > q75_vol, false) AS INT) AS sig_new_highvol,
    CAST(coalesce(round_amount_pct > q90_round, false) AS INT) AS sig_round,
    CAST(coalesce(has_mobile_update = 1, false) AS INT) AS sig_post_mobile,
    CAST(coalesce(total_volume / CASE WHEN balance_mean IS NOT NULL THEN greatest(abs(balance_mean), 1) END > q90_vtob, false) AS INT) AS sig_income_mismatch,
    CAST(coalesce(branch_mule_rate_oof > q90_branch, false) AS INT) AS sig_branch_cluster,
    CAST(coalesce(residual_ratio < 0.01, false) AS INT) AS sig_residual,
    CAST(coalesce(coalesce(geo_spread_lat, 0) + coalesce(geo_spread_lon, 0) > q90_geo, false) AS INT) AS sig_geo,
    CAST(coalesce(has_prior_freeze = 1, false) AS INT) AS sig_freeze
  FROM feat, thr)"""

SIGNAL_NAMES = (
    "sig_dormant", "sig_structuring", "sig_rapid", "sig_fanout", "sig_new_highvol", "sig_round",
    "sig_post_mobile", "sig_income_mismatch", "sig_branch_cluster", "sig_residual", "sig_geo", "sig_freeze",
)
_N = len(SIGNAL_NAMES)
_CNT = " + ".join(SIGNAL_NAMES)
_VAR = " + ".join(f"pow({s} - ({_CNT}) / {_N}.0, 2)" for s in SIGNAL_NAMES)
_ENT = " + ".join(
    f"-(greatest(least({s}, 1 - 1e-9), 1e-9) * ln(greatest(least({s}, 1 - 1e-9), 1e-9)) + (1 - greatest(least({s}, 1 - 1e-9), 1e-9)) * ln(1 - greatest(least({s}, 1 - 1e-9), 1e-9)))"
    for s in SIGNAL_NAMES
)
SIGNAL_SUMMARY = f"""summ AS (
  SELECT *, {_CNT} AS multi_signal_count, CAST({_CNT} >= 3 AS INT) AS multi_signal_binary, ({_CNT}) / {_N}.0 AS signal_consistency,
         ({_VAR}) / {_N}.0 AS signal_variance, ({_ENT}) / {_N}.0 AS signal_entropy, CAST({_CNT} >= {_N} * 0.75 AS INT) AS signal_saturation,
         ({_ENT}) / {_N}.0 * CAST({_CNT} >= {_N} * 0.75 AS INT) AS too_perfect_score
  FROM sig)"""
SIGNAL_GROUPS = ("core", "behaviour", "distinct", "dwell", "life", "balance", "geo", "residual", "flags", "encode")
