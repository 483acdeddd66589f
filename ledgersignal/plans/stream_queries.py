"""Queries run as Structured Streaming jobs over the event table."""

from __future__ import annotations

import uuid

from ledgersignal.operators import account as AC
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.registry import query
from ledgersignal.session import ensure_checkpoint_dir
from ledgersignal.sources import adapters as AD
from ledgersignal.streaming import ledger_stream as LS

A = "account_id"
W = O.with_


SLICES = 4


def event_stream(spark, sf):
    schema = AD.table(spark, sf, "events").schema
    raw = LS.read_parquet_stream(spark, sf, schema, "events.parquet")
    return AD.event_rows(raw)


def replayed(spark, sf):
    """Events in the order of time over several micro-batches."""
    events = AD.table(spark, sf, "events")
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}/in"
    LS.replay(events, folder, SLICES)
    return AD.event_rows(LS.read_parquet_stream(spark, folder, events.schema, "*.parquet", max_files=1))


def places(spark) -> tuple[str, str]:
    """A fresh output and checkpoint folder below the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query("stream_core_stats", i="account_id txn_count near_threshold_count", d="total_volume amt_max amt_std", sql=W("SELECT account_id, count(*) AS txn_count, count(*) FILTER (a >= 45000 AND a < 50000) AS near_threshold_count, sum(c) / 100 AS total_volume, max(a) AS amt_max, stddev_samp(a) AS amt_std FROM ledger GROUP BY account_id", O.EVENTS))
def _(spark, sf):
    out, state = places(spark)
    return LS.latest(LS.run_batches(LS.stream_core_stats(event_stream(spark, sf)), lambda b: b, out, state))


@query("stream_daily_volume", i="account_id day_no v n", sql=W("SELECT account_id, datediff('day', DATE '1970-01-01', d) AS day_no, sum(c) AS v, count(*) AS n FROM (SELECT *, CAST(ts AS DATE) AS d FROM ledger) GROUP BY ALL", O.EVENTS))
def _(spark, sf):
    return LS.run_complete(replayed(spark, sf), LS.stream_daily_volume, *places(spark))


@query("stream_velocity", i="account_id start_day v n", sql=W("SELECT account_id, datediff('day', DATE '1970-01-01', d) AS start_day, sum(c) AS v, count(*) AS n FROM (SELECT *, CAST(ts AS DATE) - CAST(unnest(range(7)) AS INT) AS d FROM ledger) GROUP BY ALL", O.EVENTS))
def _(spark, sf):
    return LS.run_complete(replayed(spark, sf), LS.stream_velocity, *places(spark))


@query("stream_sessions", i="account_id session_start_us session_end_us v n", sql=W(f"""
  , marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER seq + INTERVAL 12 HOUR OR lag(ts) OVER seq IS NULL THEN 1 ELSE 0 END AS starts FROM ledger {O.SEQ}),
  numbered AS (SELECT *, sum(starts) OVER seq AS session FROM marked {O.SEQ})
  SELECT account_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS session_end_us, sum(c) AS v, count(*) AS n FROM numbered GROUP BY account_id, session""", O.EVENTS))
def _(spark, sf):
    return LS.run_complete(replayed(spark, sf), LS.stream_sessions, *places(spark))


@query("stream_dwell", i="account_id", d="dwell_hours", sql=W(f"SELECT account_id, dwell_hours FROM dwell WHERE dwell_hours <= {LS.LONGEST_DWELL}", O.EVENTS, O.dwell(50)))
def _(spark, sf):
    return LS.run_complete(replayed(spark, sf), lambda txn: LS.stream_dwell(txn, 50), *places(spark))


# Estimates are judged against the whole ledger: the share of amounts up to the estimated median, and distinct counterparties.
@query("merge_batches", i="account_id txn_count median_within_bound distinct_within_bound", d="total_volume amt_mean amt_std amt_min amt_max", sql=W("SELECT account_id, count(*) AS txn_count, sum(c) / 100 AS total_volume, sum(c) / count(*) / 100 AS amt_mean, stddev_samp(c / 100) AS amt_std, min(c) / 100 AS amt_min, max(c) / 100 AS amt_max, 1 AS median_within_bound, 1 AS distinct_within_bound FROM ledger GROUP BY account_id", O.EVENTS))
def _(spark, sf):
    merged = AC.merge_partials(LS.merge_batches(replayed(spark, sf), *places(spark)))
    return AC.judged_estimates(merged, AD.event_ledger(spark, sf))
