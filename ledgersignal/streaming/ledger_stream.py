"""Structured Streaming forms of the ledger operators.

Results go to files in a shared folder, never to the driver. Re-running a micro-batch overwrites the
same ``batch_id`` folder, so a restarted query does not double its output.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ledgersignal.functions import scalars as S
from ledgersignal.operators.account import combine_partials, partial_stats

A = "account_id"


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_core_stats(txn: DataFrame) -> DataFrame:
    """Running per-account statistics; distinct counterparties by sketch (streams have no exact one)."""
    a = F.abs("amount")
    return txn.groupBy(A).agg(
        F.count(F.lit(1)).alias("txn_count"),
        (F.sum(S.cents(a)) / 100).alias("total_volume"),
        F.max(a).alias("amt_max"),
        F.stddev_samp(a).alias("amt_std"),
        F.count_if(S.near_threshold(a)).alias("near_threshold_count"),
        F.approx_count_distinct("counterparty_id").alias("cp_estimate"),
    )


def event_time(txn: DataFrame) -> DataFrame:
    """Event time as a TIMESTAMP, which watermarks need; wall-clock values are read as UTC."""
    if dict(txn.dtypes)["ts"] == "timestamp":
        return txn
    return txn.withColumn("ts", F.timestamp_micros(S.micros("ts")))


def _day_no(ts: str):
    return F.floor(F.unix_micros(ts) / 86_400_000_000).cast("bigint")


def _volume(grouped) -> DataFrame:
    return grouped.agg(F.sum(S.cents(F.abs("amount"))).alias("v"), F.count(F.lit(1)).alias("n"))


def stream_daily_volume(txn: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling day windows, emitted once the watermark has passed them."""
    out = _volume(event_time(txn).withWatermark("ts", delay).groupBy(A, F.window("ts", "1 day")))
    return out.select(A, _day_no("window.start").alias("day_no"), "v", "n")


def stream_velocity(txn: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sliding windows of volume and count."""
    out = _volume(event_time(txn).withWatermark("ts", delay).groupBy(A, F.window("ts", width, slide)))
    return out.select(A, _day_no("window.start").alias("start_day"), "v", "n")


def stream_sessions(txn: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Bursts of activity separated by at least ``gap``."""
    out = _volume(event_time(txn).withWatermark("ts", delay).groupBy(A, F.session_window("ts", gap)))
    return out.select(A, F.unix_micros("session_window.start").alias("session_start_us"), F.unix_micros("session_window.end").alias("session_end_us"), "v", "n")


class DwellPairs(StatefulProcessor):
    """Pairs an account's large credits and debits in the order of their times, whatever order they come in.

    Rows wait in state until the watermark has passed them, so a row that comes late, but not later than the
    watermark allows, takes its place. Later ones are dropped. Between rows the state is the time and type of
    the last one; it is dropped once ``longest`` has passed, when no pair can follow from it. Waiting rows are put
    and fetched as one list, since every call to the state store is an exchange with another process.
    """

    def __init__(self, longest_us: int):
        self.longest_us = longest_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, txn_id string, credit boolean")
        self.last = handle.getValueState("last", "us bigint, credit boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(r.us, r.txn_id, r.credit) for r in rows if key[0] is not None and r.us > passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(us for us, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(us, txn_id): credit for us, txn_id, credit in self.waiting.get()}  # a repeated row counts once
        ready = [(us, txn_id, credit) for (us, txn_id), credit in waiting.items() if us <= passed]
        later = [(us, txn_id, credit) for (us, txn_id), credit in waiting.items() if us > passed]
        last = self.last.get()
        found = []
        for us, txn_id, credit in sorted(ready):
            if last is not None and last[1] and not credit and us - last[0] <= self.longest_us:
                found.append(Row(**{A: key[0], "txn_id": txn_id, "dwell_hours": (us - last[0]) / 3.6e9}))
            last = (us, credit)
        if ready and later:
            self.waiting.put(later)
        elif ready:
            self.waiting.clear()
        if later:
            self.handle.registerTimer(min(us for us, _, _ in later) // 1000 + 1)
        if last is not None and last[0] + self.longest_us <= passed:
            self.last.clear()
        elif ready:
            self.last.update(last)
            self.handle.registerTimer((last[0] + self.longest_us) // 1000 + 1)
        return iter(found)

    def close(self) -> None:
        pass


#: Time of the closing row; no window of a ledger reaches it.
CLOSING = datetime.datetime(9000, 1, 1)
#: Longest time from a large credit to the debit that takes it, in hours.
LONGEST_DWELL = 30 * 24.0


def stream_dwell(txn: DataFrame, min_amount: float = S.LARGE_AMOUNT, longest: float = LONGEST_DWELL, delay: str = "1 day") -> DataFrame:
    """Large credit -> debit dwell times of up to ``longest`` hours.

    Needs the state store that ``run_append`` sets. Equal to ``dwell_state_pairs`` up to ``longest``, as long as
    rows come at most ``delay`` after later ones. Rows with equal times are ordered by id as text.
    """
    rows = event_time(txn).withWatermark("ts", delay)
    # Filters go below the watermark, so the closing row must pass them to move it.
    closing = F.col(A).isNull() & (F.col("ts") >= F.lit(CLOSING))
    rows = rows.filter(closing | (F.col(A).isNotNull() & S.is_large_ge(F.abs("amount"), min_amount) & F.col("txn_type").isin("C", "D")))
    # Whole numbers as text of equal length sort as numbers do.
    number = isinstance(txn.schema["txn_id"].dataType, T.IntegralType)
    text = F.lpad(F.col("txn_id").cast("string"), 20, "0") if number else F.col("txn_id")
    rows = rows.select(A, "ts", text.alias("txn_id"), S.micros("ts").alias("us"), (F.col("txn_type") == "C").alias("credit"))
    schema = T.StructType([T.StructField(A, txn.schema[A].dataType), T.StructField("txn_id", T.StringType()), T.StructField("dwell_hours", T.DoubleType())])
    pairs = rows.groupBy(A).transformWithState(DwellPairs(int(longest * 3_600_000_000)), schema, "Append", "EventTime")
    return pairs.withColumn("txn_id", F.col("txn_id").cast(txn.schema["txn_id"].dataType))


# The setting of the state store, and the store that keyed state with timers needs.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything available and return the written rows. The caller's settings stay as they are."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, KEYED_STORE)
    try:  # a query keeps the settings that it was started with
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, result: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """All results of a stream that ends: what it delivers by itself, then what was open at its end.

    A second source stands beside the stream. After everything has been read it gets one row without an account
    from far in the future, which moves the watermark past every window and timer, and the same query goes on.
    The stream is closed by that: later rows would be late.
    """
    spark, closing = stream.sparkSession, f"{checkpoint}-closing"
    fields = {f.name: F.lit(None).cast(f.dataType) for f in stream.schema}
    end = spark.range(1).select(*[(F.lit(CLOSING).cast(stream.schema["ts"].dataType) if name == "ts" else value).alias(name) for name, value in fields.items()])
    end.limit(0).write.parquet(closing)
    both = result(stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing)))
    run_append(both, out, checkpoint)
    end.write.mode("append").parquet(closing)
    return run_append(both, out, checkpoint).filter(F.col(A).isNotNull())


def replay(table: DataFrame, folder: str, slices: int, ts: str = "ts") -> None:
    """Write a table as files that a stream with one file a trigger reads in slices of time, one after the other."""
    if table.isEmpty():
        table.write.parquet(folder)
        return
    us = S.micros(ts)
    low, high = table.agg(F.min(us), F.max(us)).first()
    at = F.least(F.floor((us - low) * slices / (high - low + 1)), F.lit(slices - 1))
    for i in range(slices):
        table.filter(at == i).coalesce(1).write.mode("append").parquet(folder)


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Write each micro-batch to its own ``batch_id`` folder and return all of them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(out)


def latest(updates: DataFrame, key: str = A) -> DataFrame:
    """Last value per key of an update-mode output."""
    values = [c for c in updates.columns if c not in (key, "batch_id")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(key, "_v.*")


def merge_batches(txn: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Keep one row of mergeable partials per account, merged with every micro-batch; returns the last state.

    Two tables take turns: batch b merges its partials into the table of batch b - 1 and writes the other one,
    then notes b beside it. A batch that is run again reads what it read before and writes the same, so nothing
    is counted twice; a batch that did not finish has left the noted table alone.
    """
    spark = txn.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = partial_stats(batch, None)
        if batch_id:
            new = combine_partials(spark.read.parquet(f"{out}/state={(batch_id - 1) % 2}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{out}/state={batch_id % 2}")
        noted = spark.range(1).select(F.lit(batch_id).alias("batch"))
        noted.write.mode("overwrite").parquet(f"{out}/note={batch_id % 2}")

    query = txn.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current_state(spark, out)


def current_state(spark: SparkSession, out: str) -> DataFrame:
    """The state after the last finished batch: one row per account."""
    last = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{out}/note=*").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{out}/state={last % 2}")
