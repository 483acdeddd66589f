"""Queries over sources, expressions, joins, account aggregates and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators import account as AC
from ledgersignal.operators import passthrough as PT
from ledgersignal.operators import ranking as RK
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import windows as WI
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.feature_table import features, stored_features
from ledgersignal.plans.registry import query
from ledgersignal.sources import adapters as AD
from ledgersignal.sources import readers as RD

A = "account_id"
W = O.with_


def ledger(spark, sf, mcc=False):
    return AD.lineitem_ledger(spark, sf, mcc)


# ---- sources -------------------------------------------------------------------------------

@query("scan_for_accounts", i="account_id n", d="volume", sql=W("SELECT account_id, count(*) AS n, sum(c) / 100 AS volume FROM ledger WHERE account_id IN (SELECT account_id FROM labels_t WHERE is_mule = 1) GROUP BY account_id", O.LEDGER, O.LABELS))
def _(spark, sf):
    txn = RD.scan_for_accounts(ledger(spark, sf), AD.labels(spark, sf).filter("is_mule = 1"))
    return txn.groupBy(A).agg(F.count("*").alias("n"), (F.sum(S.cents(F.abs("amount"))) / 100).alias("volume"))


@query("sample_accounts", i="account_id n", sql=W("SELECT account_id, count(*) AS n FROM ledger WHERE " + O.bucket("account_id", "sample", 4) + " < 1 GROUP BY account_id", O.LEDGER))
def _(spark, sf):
    return RD.sample_accounts(ledger(spark, sf), 1, 4).groupBy(A).agg(F.count("*").alias("n"))


@query("parse_dates", i="o_orderkey day_no year_of", sql="""
  SELECT o_orderkey, datediff('day', DATE '1970-01-01', d) AS day_no, year(d) AS year_of
  FROM (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders)""")
def _(spark, sf):
    raw = AD.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return RD.parse_dates(raw, ["d"]).select("o_orderkey", F.unix_date("d").alias("day_no"), F.year("d").alias("year_of"))


@query("parse_mixed_ts", i="o_orderkey us", sql="""
  SELECT o_orderkey, epoch_us(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END) AS us FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("broken")
    raw = AD.table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    parsed = raw.withColumn("ts", RD.parse_mixed_ts("t", ["dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss"]))
    return parsed.select("o_orderkey", S.micros("ts").alias("us"))


@query("coerce_numeric", i="o_orderkey", d="x", sql="""
  SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS DOUBLE) AS x FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(S.cents("o_totalprice").cast("string"))
    return RD.coerce_numeric(AD.table(spark, sf, "orders").select("o_orderkey", text.alias("x")), ["x"])


@query("universe", i="account_id", sql="SELECT DISTINCT o_custkey AS account_id FROM orders UNION SELECT c_custkey FROM customer")
def _(spark, sf):
    seen = AD.table(spark, sf, "orders").select(F.col("o_custkey").alias(A))
    return RD.universe(seen, AD.labels(spark, sf))


# ---- expressions ---------------------------------------------------------------------------

@query("ledger_columns", i="k cents day_no hour day_of_month is_weekend month_day", d="abs_amount", sql=W("""
  SELECT k1 AS k, a AS abs_amount, c AS cents, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day_no, hour(ts) AS hour, day(ts) AS day_of_month,
         CAST(dayofweek(ts) IN (0, 6) AS INT) AS is_weekend, datediff('day', DATE '1970-01-01', CAST(date_trunc('month', ts) AS DATE)) AS month_day FROM ledger""", O.EVENTS))
def _(spark, sf):
    t = S.with_ledger_cols(AD.event_ledger(spark, sf))
    return t.select(F.col("txn_id").alias("k"), "cents", "day_no", "hour", "day_of_month", F.col("is_weekend").cast("int").alias("is_weekend"), F.unix_date("month").alias("month_day"), "abs_amount")


@query("amount_flags", i="l_orderkey l_linenumber near_50k band_48_50 is_round exact_round large_round small large large_ge", sql="""
  SELECT l_orderkey, l_linenumber, CAST(x >= 45000 AND x < 50000 AS INT) AS near_50k, CAST(x >= 48000 AND x < 50000 AS INT) AS band_48_50,
         CAST(x IN (1000, 5000, 10000, 50000, 100000) AS INT) AS is_round, CAST(x IN (1000, 5000, 10000, 50000) AS INT) AS exact_round,
         CAST(x >= 10000 AND x % 1000 = 0 AS INT) AS large_round, CAST(x < 500 AS INT) AS small, CAST(x > 50000 AS INT) AS large, CAST(x >= 50000 AS INT) AS large_ge
  FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000) * 1000 AS x FROM lineitem)""")
def _(spark, sf):
    x = F.col("x")
    t = AD.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice") / 1000) * 1000).alias("x"))
    flags = {"near_50k": S.near_threshold(x), "band_48_50": S.struct_band_48_50(x), "is_round": S.is_round_amount(x), "exact_round": S.is_exact_round(x), "large_round": S.is_large_round(x), "small": S.is_small(x), "large": S.is_large(x), "large_ge": S.is_large_ge(x)}
    return t.withColumns({k: v.cast("int") for k, v in flags.items()})


@query("time_flags", i="k night month_boundary weekend", s="action", sql=W("""
  SELECT k1 AS k, CAST(hour(ts) < 6 AS INT) AS night, CAST(day(ts) <= 5 OR day(ts) >= 26 AS INT) AS month_boundary, CAST(dayofweek(ts) IN (0, 6) AS INT) AS weekend,
         txn_type || '_' || channel AS action FROM ledger""", O.EVENTS))
def _(spark, sf):
    t = AD.event_ledger(spark, sf)
    return t.select(F.col("txn_id").alias("k"), S.is_night(F.hour("ts")).cast("int").alias("night"), S.is_month_boundary(F.dayofmonth("ts")).cast("int").alias("month_boundary"), S.is_weekend("ts").cast("int").alias("weekend"), S.action_code().alias("action"))


@query("one_hot", i="account_id scheme_AUTOMOBILE scheme_BUILDING scheme_MACHINERY", sql="""
  SELECT c_custkey AS account_id, CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS scheme_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INT) AS scheme_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INT) AS scheme_MACHINERY FROM customer""")
def _(spark, sf):
    return S.one_hot(AD.accounts(spark, sf), "scheme_code", ["AUTOMOBILE", "BUILDING", "MACHINERY"], "scheme")


@query("scalar_math", i="account_id flag", d="ratio logged bounded", s="start_text end_text", sql="""
  SELECT c_custkey AS account_id, CAST(c_mktsegment = 'BUILDING' AS INT) AS flag, 1000 / greatest(c_acctbal, 1) AS ratio, ln(1 + abs(c_acctbal)) AS logged,
         least(greatest(c_acctbal, 0), 5000) AS bounded, strftime(DATE '1995-01-01' + CAST(c_custkey AS INT), '%Y-%m-%dT00:00:00') AS start_text,
         strftime(DATE '1995-01-31' + CAST(c_custkey AS INT), '%Y-%m-%dT23:59:59') AS end_text FROM customer""")
def _(spark, sf):
    t = AD.table(spark, sf, "customer")
    day = F.unix_date(F.lit("1995-01-01").cast("date")) + F.col("c_custkey")
    start, end = S.iso_window_from_day_no("s", "e")
    out = t.select("*", day.alias("s"), (day + 30).alias("e"))
    return out.select(F.col("c_custkey").alias(A), S.flag_eq("c_mktsegment", "BUILDING").alias("flag"), S.safe_ratio(F.lit(1000), "c_acctbal").alias("ratio"), S.log_amount("c_acctbal").alias("logged"), S.clip("c_acctbal", 0.0, 5000.0).alias("bounded"), start.alias("start_text"), end.alias("end_text"))


@query("impute_median", i="account_id", d="residual_ratio median_dwell_hours", sql=W("""
  SELECT account_id, coalesce(residual_ratio, (SELECT quantile_cont(residual_ratio, 0.5) FROM feat WHERE NOT is_test)) AS residual_ratio,
         coalesce(median_dwell_hours, (SELECT quantile_cont(median_dwell_hours, 0.5) FROM feat WHERE NOT is_test)) AS median_dwell_hours FROM feat""", *O.feature_ctes("dwell", "residual")))
def _(spark, sf):
    feat = stored_features(spark, sf, ("dwell", "residual"))
    return RK.impute_median(feat, feat.filter(~F.col("is_test")), ["residual_ratio", "median_dwell_hours"])


# ---- joins and sets ------------------------------------------------------------------------

@query("assemble_features", i="account_id txn_count degree_centrality has_prior_freeze", d="credit_volume gap_cv", sql=W("SELECT * FROM feat", *O.feature_ctes("core", "flow", "distinct", "gaps", "flags")))
def _(spark, sf):
    return features(spark, sf, ("core", "flow", "distinct", "gaps", "flags"))


@query("customer_bridge", i="account_id joint", s="customer_id", sql="""
  SELECT c_custkey AS account_id, 'CUST' || (c_custkey // 2) AS customer_id, CAST((c_custkey // 2) % 3 = 0 AS INT) AS joint FROM customer""")
def _(spark, sf):
    cust = F.concat(F.lit("CUST"), F.floor(F.col("c_custkey") / 2).cast("string"))
    linkage = AD.table(spark, sf, "customer").select(cust.alias("customer_id"), F.col("c_custkey").alias(A), F.floor(F.col("c_custkey") / 2).alias("h"))
    people = linkage.select("customer_id", F.when(F.col("h") % 3 == 0, "Y").otherwise("N").alias("joint_account_flag"), F.lit("N").alias("nri_flag"), F.lit("M").alias("gender")).distinct()
    flags = AC.demographic_flags(people, linkage)
    return flags.join(linkage, A).select(A, "customer_id", F.col("is_joint").alias("joint"))


@query("attach_side_ledger", i="transaction_id l_linenumber", d="amount balance_after_transaction", sql="""
  SELECT l_orderkey AS transaction_id, l_linenumber, l_extendedprice AS amount, o_totalprice - 200000 AS balance_after_transaction FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf):
    txn = AD.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), "l_linenumber", F.col("l_extendedprice").alias("amount"))
    return SQ.attach_side_ledger(txn, AD.side_ledger(spark, sf).select("transaction_id", "balance_after_transaction"))


@query("labelled", i="account_id txn_count is_mule", sql=W("SELECT account_id, txn_count, is_mule FROM core JOIN labels_t USING (account_id) WHERE NOT is_test", O.LEDGER, O.LABELS, O.CORE))
def _(spark, sf):
    return AC.core_stats(ledger(spark, sf)).join(AD.labels(spark, sf).filter(~F.col("is_test")), A)


@query("set_operations", i="supplier_id", sql="""
  SELECT l_suppkey AS supplier_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_extendedprice > 100000 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""")
def _(spark, sf):
    lines = AD.table(spark, sf, "lineitem")
    a = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("supplier_id"))
    b = lines.filter("l_extendedprice > 100000").select("l_suppkey")
    gone = AD.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("supplier_id"))
    return a.intersect(b).join(gone, "supplier_id", "left_anti")


@query("dwell_pairs", i="account_id credit_us debit_us", d="dwell_hours", sql=W("SELECT account_id, epoch_us(credit_ts) AS credit_us, epoch_us(debit_ts) AS debit_us, dwell_hours FROM dwell", O.LEDGER, O.DWELL))
def _(spark, sf):
    return SQ.dwell_pairs(ledger(spark, sf)).select(A, S.micros("credit_ts").alias("credit_us"), S.micros("debit_ts").alias("debit_us"), "dwell_hours")


@query("dwell_state_pairs", i="account_id credit_us debit_us", d="dwell_hours", sql=W("SELECT account_id, epoch_us(credit_ts) AS credit_us, epoch_us(debit_ts) AS debit_us, dwell_hours FROM dwell", O.EVENTS, O.dwell(50)))
def _(spark, sf):
    return SQ.dwell_state_pairs(AD.event_ledger(spark, sf), 50).select(A, S.micros("credit_ts").alias("credit_us"), S.micros("debit_ts").alias("debit_us"), "dwell_hours")


@query("passthrough_pairs", i="account_id txn_id amount_match", d="passthrough_hours", sql=W("""
  SELECT c.account_id, c.k1 AS txn_id, (epoch_us(d.ts) - epoch_us(c.ts)) / 3.6e9 AS passthrough_hours, CAST(abs(d.c - c.c) <= 0.05 * c.c AS INT) AS amount_match
  FROM (SELECT * FROM ledger WHERE txn_type = 'C') c ASOF JOIN (SELECT * FROM ledger WHERE txn_type = 'D') d ON c.account_id = d.account_id AND c.ts < d.ts
  WHERE epoch_us(d.ts) - epoch_us(c.ts) <= 48 * 3600000000""", O.EVENTS))
def _(spark, sf):
    return SQ.passthrough_pairs(AD.event_ledger(spark, sf))


# Credits are served one after the other; a debit once taken is in the list that goes along.
@query("passthrough_matches", i="account_id txn_id debit_txn_id", d="passthrough_hours", sql="WITH RECURSIVE " + ", ".join([O.EVENTS, """
  numbered AS (SELECT account_id, k1, ts, c, row_number() OVER (PARTITION BY account_id ORDER BY ts, k1) AS i FROM ledger WHERE txn_type = 'C'),
  served AS (
    SELECT account_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS txn_id, CAST(NULL AS BIGINT) AS debit, CAST([] AS BIGINT[]) AS used FROM numbered WHERE i = 1
    UNION ALL
    SELECT account_id, i, txn_id, debit, CASE WHEN debit IS NULL THEN used ELSE list_append(used, debit) END FROM (
      SELECT n.account_id, n.i, n.k1 AS txn_id, s.used, (SELECT arg_min(d.k1, struct_pack(t := d.ts, k := d.k1)) FROM ledger d
        WHERE d.account_id = n.account_id AND d.txn_type = 'D' AND (d.ts > n.ts OR (d.ts = n.ts AND d.k1 > n.k1)) AND epoch_us(d.ts) - epoch_us(n.ts) <= 48 * 3600000000
          AND abs(d.c - n.c) * 10000 <= 2500 * n.c AND NOT list_contains(s.used, d.k1)) AS debit
      FROM served s JOIN numbered n ON n.account_id = s.account_id AND n.i = s.i + 1))"""]) + """
  SELECT s.account_id, s.txn_id, s.debit AS debit_txn_id, (epoch_us(d.ts) - epoch_us(c.ts)) / 3.6e9 AS passthrough_hours
  FROM served s JOIN ledger c ON c.k1 = s.txn_id JOIN ledger d ON d.k1 = s.debit""")
def _(spark, sf):
    return PT.passthrough_matches(AD.event_ledger(spark, sf), tol=0.25)


# ---- account aggregates --------------------------------------------------------------------

@query("core_stats", i="account_id txn_count", d="total_volume amt_mean amt_std amt_max", sql=W("SELECT * FROM core", O.LEDGER, O.CORE))
def _(spark, sf):
    return AC.core_stats(ledger(spark, sf))


@query("flow_split", i="account_id", d="credit_volume debit_volume", sql=W("SELECT * FROM flow", O.LEDGER, O.FLOW))
def _(spark, sf):
    return AC.flow_split(ledger(spark, sf))


@query("credit_debit_symmetry", i="account_id", d="credit_debit_symmetry", sql=W("SELECT account_id, least(credit_volume, debit_volume) / greatest(credit_volume, debit_volume, 1) AS credit_debit_symmetry FROM flow", O.LEDGER, O.FLOW))
def _(spark, sf):
    return AC.credit_debit_symmetry(AC.flow_split(ledger(spark, sf)))


BEHAVIOUR = dict(i="account_id near_threshold_count round_count small_count night_count", d="near_threshold_pct round_amount_pct life_ratio night_txn_pct")


@query("behaviour_counts", **BEHAVIOUR, sql=W("SELECT * FROM behaviour", O.LEDGER, O.BEHAVIOUR))
def _(spark, sf):
    return AC.behaviour_counts(ledger(spark, sf))


@query("behaviour_counts_events", **BEHAVIOUR, sql=W("SELECT * FROM behaviour", O.EVENTS, O.BEHAVIOUR))
def _(spark, sf):
    return AC.behaviour_counts(AD.event_ledger(spark, sf))


@query("refined_counts", i="account_id", d="struct_48_50_pct struct_45_50_pct weekend_pct large_round_pct exact_round_pct month_boundary_pct max_single_txn_pct reversal_ratio", sql=W("""
  SELECT account_id, count(*) FILTER (a >= 48000 AND a < 50000) / count(*) AS struct_48_50_pct, count(*) FILTER (a >= 45000 AND a < 50000) / count(*) AS struct_45_50_pct,
         count(*) FILTER (dayofweek(ts) IN (0, 6)) / count(*) AS weekend_pct, count(*) FILTER (a >= 10000 AND a % 1000 = 0) / count(*) AS large_round_pct,
         count(*) FILTER (a IN (1000, 5000, 10000, 50000)) / count(*) AS exact_round_pct, count(*) FILTER (day(ts) <= 5 OR day(ts) >= 26) / count(*) AS month_boundary_pct,
         max(a) / greatest(sum(c) / 100, 1) AS max_single_txn_pct, count(*) FILTER (amount < 0) / count(*) AS reversal_ratio FROM ledger GROUP BY account_id""", O.LEDGER))
def _(spark, sf):
    return AC.refined_counts(ledger(spark, sf))


DISTINCT = "account_id degree_centrality credit_cp_n debit_cp_n mcc_nunique channel_diversity active_days"


@query("distinct_counts", i=DISTINCT, sql=W("SELECT * FROM distinct_c", O.LEDGER, O.DISTINCT))
def _(spark, sf):
    return AC.distinct_counts(ledger(spark, sf, mcc=True))


@query("fan_ratio", i="account_id", d="fan_ratio", sql=W("SELECT account_id, credit_cp_n / greatest(debit_cp_n, 1) AS fan_ratio FROM distinct_c", O.EVENTS, O.DISTINCT))
def _(spark, sf):
    return AC.fan_ratio(AC.distinct_counts(AD.event_ledger(spark, sf)))


def _entropy_sql(source, column, name, min_rows):
    return W(f"""SELECT account_id, CASE WHEN sum(n) >= {min_rows} THEN greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) END AS {name}
      FROM (SELECT account_id, {column}, count(*) AS n FROM ledger WHERE {column} IS NOT NULL GROUP BY ALL) GROUP BY account_id""", source)


@query("counterparty_entropy", i="account_id", d="counterparty_entropy", sql=_entropy_sql(O.LEDGER, "counterparty_id", "counterparty_entropy", 1))
def _(spark, sf):
    return AC.counterparty_entropy(ledger(spark, sf))


@query("mcc_entropy", i="account_id", d="mcc_entropy", sql=_entropy_sql(O.LEDGER, "mcc_code", "mcc_entropy", 5))
def _(spark, sf):
    return AC.mcc_entropy(ledger(spark, sf, mcc=True))


@query("channel_entropy", i="account_id", d="channel_entropy", sql=_entropy_sql(O.EVENTS, "channel", "channel_entropy", 1))
def _(spark, sf):
    return AC.entropy(AD.event_ledger(spark, sf), "channel", "channel_entropy")


@query("first_large", i="account_id first_us days_to_first_large", sql=W("SELECT account_id, epoch_us(first_large_ts) AS first_us, days_to_first_large FROM life", O.LEDGER, O.ACCOUNTS, O.FIRST_LARGE))
def _(spark, sf):
    return AC.first_large(ledger(spark, sf), AD.accounts(spark, sf)).withColumn("first_us", S.micros("first_large_ts"))


@query("median_dwell", i="account_id", d="median_dwell_hours", sql=W("SELECT * FROM dwell_m", O.LEDGER, O.DWELL, O.DWELL_MEDIAN))
def _(spark, sf):
    return AC.median_dwell(SQ.dwell_pairs(ledger(spark, sf)))


@query("merge_partials", i="account_id txn_count", d="total_volume amt_mean amt_std amt_min amt_max", sql=W("SELECT account_id, count(*) AS txn_count, sum(c) / 100 AS total_volume, sum(c) / count(*) / 100 AS amt_mean, stddev_samp(c / 100) AS amt_std, min(c) / 100 AS amt_min, max(c) / 100 AS amt_max FROM ledger GROUP BY account_id", O.LEDGER))
def _(spark, sf):
    txn = ledger(spark, sf).withColumn("batch", F.trunc(F.to_date("ts"), "year"))
    return AC.merge_partials(AC.partial_stats(txn, "batch"))


MCC_STATS = "mcc_s AS (SELECT mcc_code, avg(a) AS mcc_mean, stddev_pop(a) AS mcc_std, count(*) AS n FROM ledger WHERE mcc_code IS NOT NULL GROUP BY mcc_code)"


@query("mcc_global_stats", s="mcc_code", i="n", d="mcc_mean mcc_std", sql=W("SELECT * FROM mcc_s", O.LEDGER, MCC_STATS))
def _(spark, sf):
    return AC.mcc_global_stats(ledger(spark, sf, mcc=True))


@query("mcc_anomaly", i="account_id mcc_zscore_gt2", d="mcc_zscore_max mcc_zscore_mean unusual_mcc_pct", sql=W("""
  SELECT account_id, max(z) AS mcc_zscore_max, avg(z) AS mcc_zscore_mean, count(*) FILTER (z > 2) AS mcc_zscore_gt2, count(*) FILTER (z > 2) / count(*) AS unusual_mcc_pct
  FROM (SELECT account_id, coalesce((a - mcc_mean) / greatest(mcc_std, 1), 0) AS z FROM ledger LEFT JOIN mcc_s USING (mcc_code)) GROUP BY account_id""", O.EVENTS, MCC_STATS))
def _(spark, sf):
    txn = AD.event_ledger(spark, sf)
    return AC.mcc_anomaly(txn, AC.mcc_global_stats(txn))


@query("salary_regularity", i="account_id months_with_credits", d="salary_irregularity", sql=W("""
  SELECT account_id, count(*) AS months_with_credits, coalesce(stddev_samp(m), 0) / greatest(avg(m), 1) AS salary_irregularity
  FROM (SELECT account_id, date_trunc('month', ts) AS mo, sum(c) / 100 AS m FROM ledger WHERE txn_type = 'C' GROUP BY ALL) GROUP BY account_id""", O.LEDGER))
def _(spark, sf):
    return AC.salary_regularity(ledger(spark, sf))


@query("share_counts", i="account_id shared_phone_count shared_address_count", sql="""
  SELECT c_custkey AS account_id, CASE WHEN phone IS NOT NULL THEN count(*) OVER (PARTITION BY phone) END AS shared_phone_count, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS shared_address_count
  FROM (SELECT *, CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey END AS phone FROM customer)""")
def _(spark, sf):
    dim = AD.table(spark, sf, "customer").select(F.col("c_custkey").alias(A), F.when(F.col("c_nationkey") % 6 != 0, F.col("c_nationkey")).alias("phone"), F.col("c_nationkey").alias("zip"), "c_mktsegment")
    return AC.share_counts(dim, {"shared_phone_count": ["phone"], "shared_address_count": ["zip", "c_mktsegment"]})


@query("code_shares", i="account_id", d="cash_txn_pct loan_txn_pct customer_induced_pct bank_induced_pct", sql=W("""
  SELECT account_id, count(*) FILTER (sub_type = 'CLT_CASH') / greatest(count(sub_type), 1) AS cash_txn_pct, count(*) FILTER (sub_type = 'LOAN') / greatest(count(sub_type), 1) AS loan_txn_pct,
         count(*) FILTER (part_type = 'CI') / greatest(count(part_type), 1) AS customer_induced_pct, count(*) FILTER (part_type = 'BI') / greatest(count(part_type), 1) AS bank_induced_pct FROM side GROUP BY account_id""", O.SIDE))
def _(spark, sf):
    return AC.code_shares(AD.side_ledger(spark, sf))


@query("code_pivot", i="account_id CI BI P", sql=W("SELECT account_id, count(*) FILTER (part_type = 'CI') AS CI, count(*) FILTER (part_type = 'BI') AS BI, count(*) FILTER (part_type = 'P') AS P FROM side GROUP BY account_id", O.SIDE))
def _(spark, sf):
    return AC.code_pivot(AD.side_ledger(spark, sf), "part_transaction_type", ["CI", "BI", "P"])


@query("ip_diversity", i="account_id unique_ip_count", d="ip_per_txn", sql=W("SELECT account_id, count(DISTINCT ip) AS unique_ip_count, count(DISTINCT ip) / count(*) AS ip_per_txn FROM side GROUP BY account_id", O.SIDE))
def _(spark, sf):
    return AC.ip_diversity(AD.side_ledger(spark, sf))


@query("geo_spread", i="account_id geo_unique_locations", d="geo_spread_lat geo_spread_lon geo_spread_total", sql=W("SELECT *, abs(geo_spread_lat) + abs(geo_spread_lon) AS geo_spread_total FROM geo", O.SIDE, O.GEO))
def _(spark, sf):
    return AC.geo_spread(AD.side_ledger(spark, sf))


@query("balance_dynamics", i="account_id zero_crossings", d="balance_mean balance_std balance_min", sql=W("SELECT account_id, balance_mean, balance_std, balance_min, zero_crossings FROM (SELECT DISTINCT account_id FROM side) LEFT JOIN balance USING (account_id)", O.SIDE, O.BALANCE))
def _(spark, sf):
    return AC.balance_dynamics(AD.side_ledger(spark, sf))


@query("residual", i="account_id is_tiny_residual", d="residual_ratio", sql=W("SELECT account_id, residual_ratio, CAST(coalesce(residual_ratio < 0.001, false) AS INT) AS is_tiny_residual FROM resid", O.LEDGER, O.ACCOUNTS, O.CORE, O.RESIDUAL))
def _(spark, sf):
    return AC.residual(AD.accounts(spark, sf), AC.core_stats(ledger(spark, sf)))


@query("account_flags", i="account_id has_prior_freeze has_unfreeze is_frozen has_mobile_update", sql=W("SELECT * FROM flags", O.ACCOUNTS, O.FLAGS))
def _(spark, sf):
    return AC.account_flags(AD.accounts(spark, sf))


AGE = "age AS (SELECT account_id, coalesce(datediff('day', last_kyc_date, DATE '2002-01-01'), 9999) AS kyc_age_days, coalesce(datediff('day', opening_date, DATE '2002-01-01'), 9999) AS account_age_days FROM accounts)"


@query("account_age", i="account_id kyc_age_days account_age_days", sql=W("SELECT * FROM age", O.ACCOUNTS, AGE))
def _(spark, sf):
    return AC.account_age(AD.accounts(spark, sf), "2002-01-01")


@query("balance_ratios", i="account_id", d="balance_volatility balance_daily_ratio volume_per_day", sql=W("""
  SELECT account_id, abs(coalesce(monthly_avg_balance, 0) - coalesce(quarterly_avg_balance, 0)) / greatest(abs(coalesce(quarterly_avg_balance, 0)), 1) AS balance_volatility,
         coalesce(daily_avg_balance, 0) / greatest(abs(coalesce(avg_balance, 0)), 1) AS balance_daily_ratio, coalesce(total_volume, 0) / greatest(account_age_days, 1) AS volume_per_day
  FROM accounts JOIN age USING (account_id) LEFT JOIN core USING (account_id)""", O.LEDGER, O.ACCOUNTS, O.CORE, AGE))
def _(spark, sf):
    acc = AD.accounts(spark, sf)
    return AC.balance_ratios(acc, AC.account_age(acc, "2002-01-01"), AC.core_stats(ledger(spark, sf)))


@query("branch_profile", i="account_id is_urban is_rural", d="branch_employee_count branch_turnover branch_asset_size", sql="""
  SELECT c_custkey AS account_id, CAST(n_regionkey IN (0, 1) AS INT) AS is_urban, CAST(n_regionkey = 2 AS INT) AS is_rural,
         CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 10 END AS branch_employee_count, n_nationkey * 1000 AS branch_turnover, n_nationkey * 7 AS branch_asset_size FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    n = F.col("n_nationkey")
    branch = AD.table(spark, sf, "nation").select(n.alias("branch_code"), F.when(F.col("n_regionkey").isin(0, 1), "urban").when(F.col("n_regionkey") == 2, "rural").otherwise("semi").alias("branch_type"), F.when(n % 5 != 0, (n * 10).cast("string")).otherwise("n/a").alias("branch_employee_count"), (n * 1000).cast("string").alias("branch_turnover"), (n * 7).cast("string").alias("branch_asset_size"))
    return AC.branch_profile(AD.accounts(spark, sf), branch)


DAILY_L = f"{O.LEDGER}, daily AS (SELECT account_id, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day_no, CAST(sum(c) AS BIGINT) AS v, count(*) AS n FROM ledger GROUP BY ALL)"
DAILY_E = DAILY_L.replace(O.LEDGER, O.EVENTS)


@query("daily_series", i="account_id day_no v n", sql=W("SELECT * FROM daily", DAILY_L))
def _(spark, sf):
    return AC.daily_series(ledger(spark, sf))


@query("ks_phase_shift", i="account_id", d="ks_phase_shift", sql=W("""
  , h AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY day_no) <= count(*) OVER (PARTITION BY account_id) // 2 AS early, count(*) OVER (PARTITION BY account_id) AS nd FROM daily),
  g AS (SELECT account_id, nd, abs((count(*) FILTER (early) OVER o) / (nd // 2) - (count(*) FILTER (NOT early) OVER o) / (nd - nd // 2)) AS gap FROM h WHERE nd >= 7 WINDOW o AS (PARTITION BY account_id ORDER BY v RANGE UNBOUNDED PRECEDING))
  SELECT account_id, max(gap) AS ks_phase_shift FROM g GROUP BY account_id""", DAILY_L))
def _(spark, sf):
    return AC.ks_phase_shift(AC.daily_series(ledger(spark, sf)))


@query("volume_concentration", i="account_id", d="velocity_7d_max vol_concentration_30d", sql=W("""
  SELECT account_id, max(w7) / 100 AS velocity_7d_max, max(w30) / greatest(sum(v), 1) AS vol_concentration_30d
  FROM (SELECT *, sum(v) OVER (PARTITION BY account_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS w7, sum(v) OVER (PARTITION BY account_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS w30 FROM daily) GROUP BY account_id""", DAILY_L))
def _(spark, sf):
    return AC.volume_concentration(AC.daily_series(ledger(spark, sf)))


# ---- sequences -----------------------------------------------------------------------------

@query("gaps", i="account_id txn_id", d="gap_h", sql=W("SELECT account_id, k1 AS txn_id, gap_h FROM gap_rows WHERE gap_h IS NOT NULL", O.EVENTS, O.GAPS))
def _(spark, sf):
    return SQ.gaps(AD.event_ledger(spark, sf))


@query("gap_stats", i="account_id gap_count", d="gap_mean gap_std gap_cv", sql=W("SELECT * FROM gap_s", O.LEDGER, O.GAPS))
def _(spark, sf):
    return SQ.gap_stats(SQ.gaps(ledger(spark, sf)))


@query("gap_frequency", i="account_id high_freq_flag", d="gap_cv_v10 gap_mean_hours", sql=W("SELECT account_id, gap_std / greatest(gap_mean, 1) AS gap_cv_v10, gap_mean AS gap_mean_hours, CAST(coalesce(gap_mean < 2, false) AS INT) AS high_freq_flag FROM gap_s", O.EVENTS, O.GAPS))
def _(spark, sf):
    return SQ.gap_frequency(SQ.gap_stats(SQ.gaps(AD.event_ledger(spark, sf))))


@query("trigrams", i="account_id n", s="trigram", sql=W("SELECT * FROM tri", O.EVENTS, O.LABELS, O.TRIGRAMS))
def _(spark, sf):
    return SQ.trigram_counts(SQ.trigrams(AD.event_ledger(spark, sf)))


@query("trigram_enrichment", i="mule_count legit_count", d="enrichment", s="trigram", sql=W("SELECT * FROM enriched", O.EVENTS, O.LABELS, O.TRIGRAMS))
def _(spark, sf):
    return SQ.trigram_enrichment(SQ.trigram_counts(SQ.trigrams(AD.event_ledger(spark, sf))), AD.labels(spark, sf))


@query("trigram_features", i="account_id mule_trigram_count", d="trigram_diversity", sql=W("SELECT account_id, coalesce(trigram_diversity, 0) AS trigram_diversity, coalesce(mule_trigram_count, 0) AS mule_trigram_count FROM labels_t LEFT JOIN tri_s USING (account_id)", O.EVENTS, O.LABELS, O.TRIGRAMS))
def _(spark, sf):
    counts = SQ.trigram_counts(SQ.trigrams(AD.event_ledger(spark, sf)))
    labels = AD.labels(spark, sf)
    return SQ.trigram_features(counts, SQ.trigram_enrichment(counts, labels), labels)


@query("build_vocab", i="idx", s="mcc_code", sql="SELECT p_brand AS mcc_code, row_number() OVER (ORDER BY p_brand) + 1 AS idx FROM (SELECT DISTINCT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey)")
def _(spark, sf):
    return SQ.build_vocab(ledger(spark, sf, mcc=True), "mcc_code")


@query("tail_sequence", i="account_id position length dir chan_idx mcc_idx", d="log_amt time_delta", sql=W(f"""
  , vocab AS (SELECT channel, row_number() OVER (ORDER BY channel) + 1 AS idx FROM (SELECT DISTINCT channel FROM ledger)),
  r AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER seq) / 3.6e9, 0) AS time_delta, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, k1 DESC) AS rn FROM ledger {O.SEQ}),
  t AS (SELECT *, count(*) OVER (PARTITION BY account_id) AS length FROM r WHERE rn <= 200)
  SELECT account_id, length - rn + 1 AS position, length, CASE WHEN txn_type = 'C' THEN 1 ELSE -1 END AS dir, idx AS chan_idx, idx AS mcc_idx, ln(1 + a) AS log_amt, time_delta FROM t JOIN vocab USING (channel)""", O.EVENTS))
def _(spark, sf):
    txn = AD.event_ledger(spark, sf)
    return SQ.tail_rows(txn, 200, SQ.build_vocab(txn, "mcc_code"), SQ.build_vocab(txn, "channel"))


@query("tail_tensor", i="account_id length step dir chan_idx mcc_idx", d="log_amt time_delta", sql=W(f"""
  , vocab AS (SELECT channel, row_number() OVER (ORDER BY channel) + 1 AS idx FROM (SELECT DISTINCT channel FROM ledger)),
  r AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER seq) / 3.6e9, 0) AS time_delta, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, k1 DESC) AS rn FROM ledger {O.SEQ}),
  t AS (SELECT account_id, 201 - rn AS step, CASE WHEN txn_type = 'C' THEN 1 ELSE -1 END AS dir, idx, ln(1 + a) AS log_amt, time_delta FROM r JOIN vocab USING (channel) WHERE rn <= 200),
  per AS (SELECT account_id, least(count(*), 200) AS length FROM ledger GROUP BY account_id)
  SELECT account_id, length, s.step, coalesce(dir, 0) AS dir, coalesce(idx, 0) AS chan_idx, coalesce(idx, 0) AS mcc_idx, coalesce(log_amt, 0) AS log_amt, coalesce(time_delta, 0) AS time_delta
  FROM per CROSS JOIN (SELECT unnest(range(1, 201)) AS step) s LEFT JOIN t USING (account_id, step)""", O.EVENTS))
def _(spark, sf):
    txn = AD.event_ledger(spark, sf)
    tensor = SQ.tail_sequence(SQ.tail_rows(txn, 200, SQ.build_vocab(txn, "mcc_code"), SQ.build_vocab(txn, "channel")), 200)
    return tensor.select(A, "length", F.posexplode("steps").alias("pos", "s")).select(A, "length", (F.col("pos") + 1).alias("step"), "s.*")


@query("rank_pct", i="account_id", d="amt_std_rank gap_cv_rank degree_centrality_rank", sql=W("""
  SELECT account_id, """ + ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END, 0.5) AS {c}_rank" for c in ("amt_std", "gap_cv", "degree_centrality")) + " FROM feat", *O.feature_ctes("core", "gaps", "distinct")))
def _(spark, sf):
    feat = stored_features(spark, sf, ("core", "gaps", "distinct"))
    return RK.rank_columns(feat, A, {c: F.col(c) for c in ("amt_std", "gap_cv", "degree_centrality")})


@query("rolling_z", i="account_id day_no", d="z", sql=W("""
  SELECT account_id, day_no, CASE WHEN row_number() OVER o > 10 AND stddev_pop(v) OVER p > 0 THEN (v - avg(v) OVER p) / stddev_pop(v) OVER p ELSE 0 END AS z FROM daily
  WINDOW o AS (PARTITION BY account_id ORDER BY day_no), p AS (PARTITION BY account_id ORDER BY day_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""", DAILY_L))
def _(spark, sf):
    return WI.rolling_z(AC.daily_series(ledger(spark, sf)), 10)


@query("rolling_mean", i="account_id day_no", d="smooth", sql=W("""
  , span AS (SELECT account_id, min(day_no) AS f, max(day_no) AS l FROM daily GROUP BY account_id),
  cal AS (SELECT account_id, unnest(generate_series(f, l)) AS day_no FROM span),
  dense AS (SELECT account_id, day_no, coalesce(v, 0) AS v FROM cal LEFT JOIN daily USING (account_id, day_no))
  SELECT account_id, day_no, avg(v) OVER (PARTITION BY account_id ORDER BY day_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM dense""", DAILY_E))
def _(spark, sf):
    dense = WI.dense_calendar(AC.daily_series(AD.event_ledger(spark, sf)))
    return WI.rolling_mean(dense).withColumn("smooth", F.col("smooth") / 60)


@query("range_window_sum", i="account_id day_no wv we", sql=W("""
  SELECT account_id, day_no, sum(v) OVER r AS wv, max(day_no) OVER r AS we FROM daily WINDOW r AS (PARTITION BY account_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING)""", DAILY_L))
def _(spark, sf):
    return WI.range_sum(AC.daily_series(ledger(spark, sf)), 30, "wv", end="we")


@query("volume_cdf", i="account_id day_no", d="cdf", sql=W("SELECT account_id, day_no, sum(v) OVER (PARTITION BY account_id ORDER BY day_no) / sum(v) OVER (PARTITION BY account_id) AS cdf FROM daily", DAILY_L))
def _(spark, sf):
    return WI.volume_cdf(AC.daily_series(ledger(spark, sf)))


@query("top_k", i="account_id", d="total_volume", sql=W("SELECT account_id, total_volume FROM core ORDER BY total_volume DESC, account_id LIMIT 25", O.LEDGER, O.CORE))
def _(spark, sf):
    return RK.top_k(AC.core_stats(ledger(spark, sf)), [F.col("total_volume").desc(), F.col(A)], 25)
