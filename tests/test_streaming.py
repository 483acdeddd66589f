"""Streaming results over several micro-batches equal the batch results."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersignal.operators import account as AC
from ledgersignal.operators import sequence as SQ
from ledgersignal.sources import adapters as AD
from ledgersignal.streaming import ledger_stream as LS

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def parts(spark, scratch):
    """Events cut into four files in time order, read one file per micro-batch."""
    events = AD.table(spark, SF, "events")
    for i in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = LS.read_parquet_stream(spark, f"{scratch}/in", events.schema, "*.parquet", max_files=1)
    return AD.event_rows(stream), AD.event_ledger(spark, SF), scratch


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


def test_dwell_across_batches(parts):
    stream, batch, base = parts
    got = LS.run_complete(stream, lambda txn: LS.stream_dwell(txn, 20), f"{base}/out", f"{base}/state")
    assert rows(got.select("account_id", "txn_id", "dwell_hours")) == rows(SQ.dwell_state_pairs(batch, 20).select("account_id", "txn_id", "dwell_hours"))


LEDGER = "account_id long, txn_id long, ts timestamp_ntz, amount double, txn_type string"


def ledger_stream(spark, folder, batches):
    """One file, and so one micro-batch, per list of (hour, id, type)."""
    for batch in batches:
        table = spark.createDataFrame([(7, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), 100.0, t) for h, i, t in batch], LEDGER)
        table.coalesce(1).write.mode("append").parquet(folder)
    return LS.read_parquet_stream(spark, folder, T._parse_datatype_string(LEDGER), "*.parquet", max_files=1)


def test_dwell_of_rows_out_of_order(spark, scratch):
    # The credit of hour 20 comes after the debit of hour 30, the debit of hour 21 when the watermark is behind it.
    stream = ledger_stream(spark, f"{scratch}/in", [[(0, 1, "C"), (30, 4, "D")], [(20, 2, "C"), (28, 3, "C")], [(200, 5, "C")], [(21, 9, "D"), (210, 6, "D")]])
    got = LS.run_complete(stream, lambda txn: LS.stream_dwell(txn, 50, longest=100, delay="24 hours"), f"{scratch}/out", f"{scratch}/state")
    assert rows(got) == [(7, 2.0, 4), (7, 10.0, 6)]


def test_dwell_state_expires(spark, scratch):
    stream = ledger_stream(spark, f"{scratch}/in", [[(0, 1, "C")], [(90, 2, "C")], [(301, 3, "D"), (302, 4, "C")]])
    got = LS.run_complete(stream, lambda txn: LS.stream_dwell(txn, 50, longest=100, delay="1 hour"), f"{scratch}/out", f"{scratch}/state")
    assert rows(got) == []
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{scratch}/state")
    assert state.count() == 0


def test_open_windows_come_at_the_end(parts):
    stream, batch, base = parts
    got = LS.run_complete(stream, LS.stream_daily_volume, f"{base}/out", f"{base}/state")
    daily = AC.daily_series(batch)
    assert rows(got.select("account_id", "day_no", "v", "n")) == rows(daily.select("account_id", "day_no", "v", "n"))


def test_a_batch_run_again_changes_nothing(spark, parts):
    stream, batch, base = parts
    state = LS.merge_batches(stream, f"{base}/out", f"{base}/state")
    assert state.count() == batch.select("account_id").distinct().count()
    before = rows(state.drop("cp_sketch", "amt_sketch"))
    # The commit of the last batch is lost, so it runs again.
    last = max(int(n) for n in os.listdir(f"{base}/state/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{base}/state/commits/{name}")
    again = LS.merge_batches(stream, f"{base}/out", f"{base}/state")
    assert rows(again.drop("cp_sketch", "amt_sketch")) == before


def test_partials_of_batches_merge_to_exact_results(parts):
    stream, batch, base = parts
    merged = AC.merge_partials(LS.merge_batches(stream, f"{base}/out", f"{base}/state"))
    left = rows(merged.select("account_id", "txn_count", "total_volume", "amt_mean", "amt_max"))
    assert left == rows(AC.core_stats(batch).select("account_id", "txn_count", "total_volume", "amt_mean", "amt_max"))


def test_running_statistics(parts):
    stream, batch, base = parts
    last = LS.latest(LS.run_batches(LS.stream_core_stats(stream), lambda b: b, f"{base}/out", f"{base}/state"))
    assert rows(last.select("account_id", "txn_count", "total_volume", "amt_max")) == rows(AC.core_stats(batch).select("account_id", "txn_count", "total_volume", "amt_max"))


class Store:
    """A state store in memory that counts the calls."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, [], None, []

    def getListState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows += rows

    def updateValue(self, *row):  # noqa: N802
        self.calls += 1

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)


def test_dwell_calls_the_store_per_batch_not_per_row():
    store, at = Store(), type("Times", (), {"getCurrentWatermarkInMs": lambda _: 0})()
    pairs = LS.DwellPairs(10**9)
    pairs.init(store)
    rows = [Row(us=1000 * i, txn_id=str(i), credit=i % 2 == 0) for i in range(1, 1001)]
    list(pairs.handleInputRows((1,), iter(rows), at))
    assert store.calls == 1 and store.timers == [2]


def test_dwell_of_repeated_rows_and_rows_that_wait(spark, scratch):
    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "account_id long, txn_id long, ts timestamp_ntz, amount double, txn_type string"
    batches = [[(1, 1, hour(0), 90.0, "C"), (1, 1, hour(0), 90.0, "C"), (1, 3, hour(5), -90.0, "D")], [(1, 2, hour(3), -90.0, "D"), (1, 4, hour(60), 90.0, "C"), (1, 5, hour(61), -90.0, "D")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/rows")
    stream = LS.read_parquet_stream(spark, f"{scratch}/rows", spark.createDataFrame([], schema).schema, "*.parquet", max_files=1)
    out = LS.run_complete(stream, lambda t: LS.stream_dwell(t, 50), f"{scratch}/out", f"{scratch}/state")
    assert sorted((r["txn_id"], r["dwell_hours"]) for r in out.collect()) == [(2, 3.0), (5, 1.0)]
