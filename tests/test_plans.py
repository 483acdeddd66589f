"""Shape of physical plans: what must and must not appear."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import windows as WI
from ledgersignal.sources import adapters as AD
from ledgersignal.sources import readers as RD

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = {
    "profile": lambda t: AC.account_profile(t),
    "distinct": lambda t: AC.distinct_counts(t),
    "daily": lambda t: AC.daily_series(t),
    "gaps": lambda t: SQ.gap_stats(SQ.gaps(t)),
    "dwell": lambda t: SQ.dwell_pairs(t),
    "trigrams": lambda t: SQ.trigram_counts(SQ.trigrams(t)),
    "tail": lambda t: SQ.tail_rows(t, 20),
    "multiscale": lambda t: WI.window_multiscale(AC.daily_series(t)),
    "two_pass": lambda t: WI.window_two_pass_z(AC.daily_series(t)),
    "smoothed": lambda t: WI.window_smoothed_v10(AC.daily_series(t)),
    "core_expand": lambda t: WI.window_core_expand_v11(AC.daily_series(t)),
}


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_no_python_no_single_task_no_cross_join(spark, name):
    text = plan(NATIVE[name](AD.event_ledger(spark, SF)))
    for bad in ("SinglePartition", "Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_scan_is_pruned_and_filtered(spark):
    lines = AD.table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("account_id"), "l_quantity")
    text = plan(RD.scan_for_accounts(lines, [1, 2, 3]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "In(l_orderkey, [1,2,3])" in text


def test_ledger_without_categories_skips_the_part_join(spark):
    assert "part.parquet" not in plan(AC.core_stats(AD.lineitem_ledger(spark, SF)))


def test_tail_is_limited_before_the_shuffle(spark):
    text = plan(SQ.tail_rows(AD.event_ledger(spark, SF), 20))
    assert "WindowGroupLimit" in text


def test_aggregates_combine_before_the_shuffle(spark):
    text = plan(AC.account_profile(AD.event_ledger(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_all_scales_share_one_shuffle_and_sort(spark):
    text = plan(WI.best_windows(AC.daily_series(AD.event_ledger(spark, SF)), (7, 14, 30, 60, 90)))
    assert text.count("Exchange hashpartitioning(account_id") == 2 and text.count("+- Sort [account_id") == 1
