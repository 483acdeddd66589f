"""Results must not change when keys are treated as hot."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import encode as EN
from ledgersignal.operators import network as NW
from ledgersignal.operators import ranking as RK
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import skew
from ledgersignal.sources import adapters as AD

SF = "/root/testdata/sf0.001"
HOT = {"min_rows": 8, "max_hot": 10_000}


def rows(df):
    """Sorted rows; doubles lose the last digits, whose value depends on the order of addition."""
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def txn(spark):
    """Events where one account holds a third of all rows."""
    t = AD.event_ledger(spark, SF)
    return t.withColumn("account_id", F.when(F.col("txn_id") % 3 == 0, 0).otherwise(F.col("account_id"))).cache()


@pytest.mark.parametrize("op", [SQ.gaps, SQ.trigrams, lambda t, **k: SQ.dwell_pairs(t, 20, **k), lambda t, **k: SQ.dwell_state_pairs(t, 20, **k), SQ.passthrough_pairs])
def test_ordered_operators(txn, op):
    assert rows(op(txn, **HOT)) == rows(op(txn))


def test_hot_account_is_found(txn):
    hot = skew.hot_accounts(txn, "account_id", "ts", 100, 10)
    assert [r[0] for r in hot.table.collect()] == [0]


def test_tail_needs_no_hot_handling(txn):
    tail = rows(SQ.tail_rows(txn, 30))
    lagged = txn.withColumn("prev", F.lag("ts").over(Window.partitionBy("account_id").orderBy("ts", "txn_id")))
    hours = {r.txn_id: round((r.ts - r.prev).total_seconds() / 3600, 6) if r.prev else 0.0 for r in lagged.collect()}
    names = sorted(SQ.tail_rows(txn, 30).columns)
    assert all(abs(r[names.index("time_delta")] - hours[r[names.index("txn_id")]]) < 1e-5 for r in tail)


def test_hot_list_is_bounded(txn):
    counts = txn.groupBy("account_id").agg(F.count("*").alias("n"))
    assert skew.hot_keys(counts, min_rows=0, max_hot=5).count() == 5


def test_balance_dynamics(spark):
    side = AD.side_ledger(spark, SF)
    assert rows(AC.balance_dynamics(side, min_rows=3)) == rows(AC.balance_dynamics(side))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("min_rows", [1, 5, 10**9])
def test_lookup(spark, how, min_rows):
    """Hot keys that the table has, hot and rare keys that it lacks, and rows without a key."""
    keys = ["a"] * 20 + ["gone"] * 20 + [None] * 20 + ["b", "c", "z"]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    right = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    counts = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    key = lambda r: tuple(str(x) for x in r)
    got = skew.lookup_by_key(left, right, "k", how=how, counts=counts, min_rows=min_rows)
    assert sorted(got.collect(), key=key) == sorted(left.join(right, "k", how).collect(), key=key)


@pytest.mark.parametrize(
    "op",
    [
        lambda t, **k: EN.target_encode(t.filter("txn_id % 4 > 0 and account_id > 0"), t, "account_id", "y", **k),
        lambda t, **k: EN.target_encode_oof(t.filter("account_id > 0"), t.filter("account_id = 0"), "account_id", "y", "fold", **k),
        lambda t, **k: EN.target_encode_expanding(t, "account_id", "y", "fold", 3, **k),
        lambda t, **k: AC.share_counts(t, {"same": ["account_id"]}, "txn_id", **k),
        lambda t, **k: AC.mcc_anomaly(t, AC.mcc_global_stats(t.filter("channel <> 'view'")), **k),
        lambda t, **k: AC.branch_profile(
            t.select(F.col("txn_id").alias("account_id"), F.col("account_id").cast("string").alias("branch_code")),
            t.filter("account_id % 5 > 0").select(F.col("account_id").cast("string").alias("branch_code"), F.lit("urban").alias("branch_type"), *[F.lit("1").alias(c) for c in ("branch_employee_count", "branch_turnover", "branch_asset_size")]).distinct(),
            **k,
        ),
    ],
)
def test_operators_that_look_up_hot_keys(txn, op):
    """The third of the rows that one key holds stays, also where the table lacks the key."""
    table = txn.withColumns({"y": (F.col("txn_id") % 3 == 1).cast("int"), "fold": (F.col("txn_id") % 4).cast("int")})
    key = lambda r: tuple(map(str, r))
    assert sorted(rows_(op(table, min_rows=8)), key=key) == sorted(rows_(op(table)), key=key)


def rows_(df):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()]


def bursts(spark):
    """One early row and then a burst; and many rows in one instant."""
    early = [(0, 0, "2020-01-01 00:00:00", 1.0)]
    burst = [(0, i, f"2024-06-01 10:{i // 60 % 60:02d}:{i % 60:02d}", float(i % 7) - 3) for i in range(1, 1500)]
    instant = [(1, 10_000 + i, "2024-06-01 12:00:00", float(i % 5) - 2) for i in range(1500)]
    few = [(2 + i % 9, 20_000 + i, f"2024-05-{1 + i % 28:02d} 08:00:00", float(i % 3) - 1) for i in range(90)]
    df = spark.createDataFrame(early + burst + instant + few, "account_id int, txn_id int, ts string, amount double")
    kind = F.when(F.col("amount") < 0, "D").otherwise("C")
    return df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "txn_type": kind, "channel": F.lit("x"), "mcc_code": F.lit("m")})


@pytest.mark.parametrize("op", [SQ.gaps, SQ.trigrams, lambda t, **k: SQ.dwell_pairs(t, 2, **k), lambda t, **k: SQ.dwell_state_pairs(t, 2, **k), SQ.passthrough_pairs])
def test_bursts_and_instants(spark, op):
    t = bursts(spark)
    assert rows(op(t, min_rows=100)) == rows(op(t))


def test_slices_hold_equally_many_rows(spark):
    t = bursts(spark)
    hot = skew.hot_accounts(t, min_rows=100)
    cold, sliced = skew.split_hot(t, "account_id", ("ts", "txn_id"), hot)
    sizes = [r["count"] for r in sliced.groupBy("account_id", "_slice").count().collect()]
    assert sorted(r[0] for r in hot.table.collect()) == [0, 1] and cold.count() == 90 and sum(sizes) == 3000
    assert max(sizes) <= 200


def test_lookup_with_many_rows_per_key(spark):
    left = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 99)], "k string, i int")
    right = spark.createDataFrame([("a", v) for v in range(5)] + [("b", 7)], "k string, v int")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.lookup_by_key(left, right, "k", how="inner", counts=counts, small=False, min_rows=5)
    assert rows(out) == rows(left.join(right, "k"))


def test_shared_hot_list_serves_filtered_ledgers(txn):
    hot = skew.hot_accounts(txn, min_rows=8)
    large = txn.filter(F.abs("amount") > 20)
    assert rows(SQ.gaps(large, hot=hot)) == rows(SQ.gaps(large))


def test_network_operators(txn):
    edges = NW.build_edges(txn).cache()
    assert rows(NW.clustering(edges, min_rows=20)) == rows(NW.clustering(edges))
    assert rows(NW.connected_components(edges, min_rows=20)) == rows(NW.connected_components(edges))
    assert rows(NW.communities(edges, 3, min_rows=20)) == rows(NW.communities(edges, 3))
    assert rows(NW.betweenness_sampled(edges, 3, min_rows=20)) == rows(NW.betweenness_sampled(edges, 3))
    labels = edges.select(F.col("src").alias("account_id"), (F.col("src") % 7 == 0).cast("int").alias("is_mule")).distinct()
    assert rows(NW.shared_network(edges, labels, min_rows=20)) == rows(NW.shared_network(edges, labels))
    assert rows(NW.mule_overlap(edges, labels, min_rows=20)) == rows(NW.mule_overlap(edges, labels))
    assert rows(NW.mule_exposure(edges, labels, labels, min_rows=20)) == rows(NW.mule_exposure(edges, labels, labels))
    a, b = (dict(NW.pagerank(edges, max_iter=5, tol=None, **k).collect()) for k in ({}, {"min_rows": 20}))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_grouped_quantiles_with_hot_groups(txn, monkeypatch):
    columns = {"amount": F.col("amount")}
    plain = rows(RK.exact_quantiles(txn, columns, [0.25, 0.5], by=["account_id"]))
    real = skew.fetch_hot
    monkeypatch.setattr(RK, "fetch_hot", lambda counts, keys: real(counts, keys, min_rows=50, max_hot=1000))
    assert rows(RK.exact_quantiles(txn, columns, [0.25, 0.5], by=["account_id"])) == plain


def test_row_order_and_partitioning_do_not_matter(txn):
    shuffled = txn.orderBy(F.rand(1)).repartition(5)
    for op in (AC.core_stats, AC.distinct_counts, lambda t: SQ.gap_stats(SQ.gaps(t)), AC.daily_series):
        left, right = (sorted(op(t).collect(), key=lambda r: tuple(map(str, r))) for t in (txn, shuffled))
        assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in left] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in right]
