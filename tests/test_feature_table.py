"""The ledger laid out once for all feature groups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import skew as SK
from ledgersignal.operators import windows as WI
from ledgersignal.plans import feature_table as FT
from ledgersignal.sources import adapters as AD

A = "account_id"


def tables(spark, folder):
    """Parts twice, without a brand and missing; orders without a customer; equal times."""
    day = lambda i: dt.datetime(2024, 1, 1 + i % 9)
    lines = [(o, p, 10 + n % 3, n, 100.0 * n + (p or 0), "OF"[n % 2], day(o + n)) for o in range(1, 9) for n, p in enumerate((1, 2, 3, 4, 5, None))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(o, None if o == 8 else o % 3, ["1-URGENT", "5-LOW"][o % 2]) for o in range(1, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "B1"), (1, "B1"), (2, "B1"), (2, "B2"), (3, None), (4, 'B"4')], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_laid_ledger_gives_the_same_groups_without_shuffles(spark, scratch):
    tables(spark, scratch)
    plain = AD.lineitem_ledger(spark, scratch).filter(F.col(A).isNotNull())
    laid = FT.laid_ledger(AD.lineitem_ledger(spark, scratch, mcc_list=True))
    assert rows(AC.account_profile(laid)) == rows(AC.account_profile(plain))
    assert rows(SQ.gap_stats(SQ.gaps(laid))) == rows(SQ.gap_stats(SQ.gaps(plain)))
    assert rows(SQ.trigram_counts(SQ.trigrams(laid))) == rows(SQ.trigram_counts(SQ.trigrams(plain)))
    known = laid.filter(F.col("mcc_codes").isNotNull())
    got = AC.distinct_counts(known, mcc=AD.listed_mcc(laid.select(A, "mcc_codes")))
    assert rows(got) == rows(AC.distinct_counts(AD.lineitem_ledger(spark, scratch, mcc=True).filter(F.col(A).isNotNull())))
    for group in (AC.account_profile(laid), SQ.gap_stats(SQ.gaps(laid)), known.groupBy(A).agg(F.count_distinct("channel"))):
        plan = group._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Exchange" not in plan
    laid.unpersist()


def test_large_ledger_is_dealt_by_rows_not_by_bytes(spark, scratch, monkeypatch):
    tables(spark, scratch)
    monkeypatch.setattr(FT, "LAID_ROWS", 2)
    txn = AD.lineitem_ledger(spark, scratch, mcc_list=True)
    lines = AD.table(spark, scratch, "lineitem").count()
    small, large = FT.laid_ledger(txn, 2), FT.laid_ledger(txn, lines)
    assert large.rdd.getNumPartitions() == lines // 2 > small.rdd.getNumPartitions()
    assert rows(large) == rows(small)
    for group in (AC.account_profile(large), SQ.gap_stats(SQ.gaps(large))):
        assert "Exchange" not in group._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    small.unpersist()
    large.unpersist()


def test_stored_table_is_read_in_no_more_partitions_than_usual(spark, monkeypatch):
    monkeypatch.setattr(FT, "features", lambda spark, *_: spark.range(90).repartition(60))
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stored = FT.stored_features(spark, "")
    assert stored.rdd.getNumPartitions() == usual and stored.count() == 90
    monkeypatch.setattr(FT, "STORED_ROWS", 3)
    assert FT.stored_features(spark, "").rdd.getNumPartitions() == 30


def test_calendar_is_dealt_by_its_days_not_by_the_active_ones(spark):
    daily = spark.createDataFrame([(a, d, 5) for a in range(40) for d in (0, 999)], "account_id long, day_no long, v long")
    assert WI._spread(daily, 5000).rdd.getNumPartitions() == 8
    assert WI._spread(daily.limit(0)).count() == 0
    assert WI.window_smoothed_v10(daily).count() == 40


def _orders_and_parts(spark, folder):
    """The tables above with all columns of the orders and a customer without orders."""
    tables(spark, folder)
    day = dt.datetime(2024, 1, 1)
    orders = [(o, None if o == 8 else o % 3, "OFP"[o % 3], 1000.0 * o, day + dt.timedelta(o), ["1-URGENT", "5-LOW"][o % 2]) for o in range(1, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(c, c % 2, -5.0 * c, "BUILDING") for c in range(5)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")


def test_codes_of_parts_come_back_by_account_without_the_lines(spark, scratch, monkeypatch):
    """Parts twice, without a brand and missing: the counts are those of lines joined to parts; lines are dealt once, narrow."""
    _orders_and_parts(spark, scratch)
    monkeypatch.setattr(AD, "_SCHEMAS", {})
    plain = rows(FT.features(spark, scratch))
    kept = []
    assert rows(FT.features(spark, scratch, kept=kept)) == plain
    laid, orders = kept[0], kept[1]
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" not in plan and "mcc_codes" not in laid.columns and "part_key" in laid.columns
    side = AC.balance_dynamics(AD.side_ledger(spark, scratch, orders))
    assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    for df in kept:
        df.unpersist()


def test_orders_and_their_longest_bound_the_rows_of_an_account(spark, scratch, monkeypatch):
    """The exact count by account, with its join, is made only if the bound is above the floor."""
    _orders_and_parts(spark, scratch)
    monkeypatch.setattr(AD, "_SCHEMAS", {})
    asked = []
    monkeypatch.setattr(FT, "hot_accounts", lambda txn: asked.append(1) or FT.HotAccounts(None))
    FT.feature_groups(spark, scratch, ["gaps"])
    assert not asked
    monkeypatch.setattr(FT, "MIN_HOT_ROWS", 3 * 6 - 1)  # three orders of six lines
    FT.feature_groups(spark, scratch, ["gaps"])
    assert asked


def test_longest_order_is_bounded_without_a_row_per_order(spark, scratch, monkeypatch):
    """Lines are counted by order only if the bound by buckets of orders does not rule hot accounts out; null orders count for nothing."""
    _orders_and_parts(spark, scratch)
    monkeypatch.setattr(AD, "_SCHEMAS", {})
    lines = spark.createDataFrame([(k,) for k in [1] * 7 + [2] * 5 + [None] * 90 + [*range(3, 20)]], "l_orderkey long")
    assert SK.most_rows(lines, "l_orderkey") == 7 <= SK.most_rows_bound(lines, "l_orderkey")
    assert SK.most_rows_bound(lines, "l_orderkey", 1) == 29 and SK.most_rows_bound(lines.limit(0), "l_orderkey") == 0
    counted = []
    monkeypatch.setattr(FT, "most_rows", lambda df, key: counted.append(key) or SK.most_rows(df, key))
    FT.feature_groups(spark, scratch, ["gaps"])
    assert counted == ["o_custkey"]
    monkeypatch.setattr(FT, "most_rows_bound", lambda df, key: 48)  # all orders in one bucket
    monkeypatch.setattr(FT, "MIN_HOT_ROWS", 3 * 6)
    FT.feature_groups(spark, scratch, ["gaps"])
    assert counted == ["o_custkey", "o_custkey", "l_orderkey"]


def test_lines_move_with_a_flag_for_their_status(spark, scratch, monkeypatch):
    """What is dealt has no status string; lines without a status are debits, as before."""
    _orders_and_parts(spark, scratch)
    monkeypatch.setattr(AD, "_SCHEMAS", {})
    dealt = []
    AD.lineitem_ledger(spark, scratch, deal=lambda df: dealt.append(df) or df)
    assert dict(dealt[0].dtypes)["_credit"] == "boolean"
    ledger = AD.lineitem_ledger(spark, scratch, deal=lambda df: df.repartition(3, A))
    read = ledger._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "l_linestatus" not in read and "_credit" in read
    unknown = spark.read.parquet(f"{scratch}/lineitem.parquet").withColumn("l_linestatus", F.when(F.col("l_linenumber") != 2, F.col("l_linestatus")))
    unknown.write.parquet(f"{scratch}/unknown/lineitem.parquet")
    spark.read.parquet(f"{scratch}/orders.parquet").write.parquet(f"{scratch}/unknown/orders.parquet")
    txn = AD.lineitem_ledger(spark, f"{scratch}/unknown").select("txn_id.l_linenumber", "txn_type", F.signum("amount").cast("int")).distinct()
    assert rows(txn) == sorted((1 if t == "C" else -1, n, t) for n, t in enumerate("CDDDCD"))
