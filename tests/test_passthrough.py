"""One-to-one pass-through matching against credits served one after the other."""

from __future__ import annotations

import datetime
import random

import pytest

from ledgersignal.operators import passthrough as PT

LEDGER = "account_id long, txn_id long, ts timestamp_ntz, amount double, txn_type string"


def ledger(seed, n, burst):
    """Few accounts, one with most rows; a burst has equal amounts at equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minutes = rng.choice([0, 1, 2, 2000, 2881]) if burst else rng.randint(0, 30_000)
        amount = rng.choice([100.0, 105.0, 95.0, 100.01]) if burst else round(rng.uniform(50, 150), 2)
        kind = rng.choice("CD") if rng.random() < 0.95 else "X"
        rows.append((rng.choice([1, 1, 1, 2, None]), i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes), amount if kind == "C" else -amount, kind))
    return rows


def served(rows, hours, tol):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1]))
    used, out = set(), set()
    for c in order:
        if c[4] != "C":
            continue
        for d in order:
            if d[4] == "D" and d[0] == c[0] and (d[2], d[1]) > (c[2], c[1]) and d[2] - c[2] <= datetime.timedelta(hours=hours) and d[1] not in used:
                cents = round(c[3] * 100)
                if abs(round(-d[3] * 100) - cents) * 10_000 <= round(tol * 10_000) * cents:
                    used.add(d[1])
                    out.add((c[0], c[1], d[1], round((d[2] - c[2]).total_seconds() / 3600, 6)))
                    break
    return out


@pytest.mark.parametrize(("seed", "burst", "tol", "hot"), [(1, False, 0.05, False), (2, True, 0.05, False), (3, False, 0.2, True), (4, True, 0.05, True), (5, True, 0.0, True)])
def test_matches(spark, seed, burst, tol, hot):
    rows = ledger(seed, 400, burst)
    txn = spark.createDataFrame(rows, LEDGER).repartition(4)
    got = PT.passthrough_matches(txn, tol=tol, **({"min_rows": 40, "max_hot": 10} if hot else {})).collect()
    pairs = {(r.account_id, r.txn_id, r.debit_txn_id, round(r.passthrough_hours, 6)) for r in got}
    assert len(pairs) == len(got) and pairs == served(rows, 48, tol)
    assert len({r.debit_txn_id for r in got}) == len(got)


def test_no_pairs_of_rows_are_made(spark):
    plan = PT.passthrough_matches(spark.createDataFrame(ledger(1, 50, True), LEDGER))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_burst_takes_time_in_proportion():
    """A debit finds its credit without going through all that wait."""
    waiting = PT.Waiting(10**12, 500)
    for i in range(60_000):
        waiting.put(i, i, 100_00 + i % 7)
    assert [waiting.take(60_000 + i, 100_03)[2] for i in range(60_000)] == list(range(60_000))


def test_no_rows(spark):
    assert PT.passthrough_matches(spark.createDataFrame([], LEDGER)).collect() == []
