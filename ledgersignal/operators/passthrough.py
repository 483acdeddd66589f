"""One-to-one matching of credits with later debits of about the same amount.

Credits are served in the order of time, and each takes its earliest later debit that is within the time and
amount limits and still free. Debits taking their earliest waiting credit in the order of time come to the same
pairs, because both sides rank the other by time; so one ordered pass per account with the credits that still
wait is enough, and no table of candidate pairs is made.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators.skew import MAX_HOT_KEYS, MIN_HOT_ROWS, hot_accounts, split_hot
from ledgersignal.session import cut_lineage

A = "account_id"
#: Classes of amounts per tolerance: of the classes that a debit looks into, only those at the ends are searched.
FINENESS = 4
#: Tolerances are whole numbers of these parts.
PARTS = 10_000


class Waiting:
    """Credits that wait for a debit, in the order they came and by classes of amounts."""

    def __init__(self, limit_us: int, tol: int):
        self.limit, self.tol = limit_us, tol
        self.width = math.log1p(max(tol, 1) / PARTS) / FINENESS
        self.came = 0
        self.all: deque[list] = deque()  # [number, time, id, cents, done]
        self.classes: dict[int, deque[list]] = {}

    def _class(self, cents: float) -> int:
        return math.floor(math.log(max(cents, 0.5)) / self.width)

    def forget(self, now: int) -> None:
        """Leave out credits that are taken or have waited too long."""
        while self.all and (self.all[0][4] or self.all[0][1] < now - self.limit):
            self.all.popleft()[4] = True

    def put(self, us: int, txn_id, cents: int) -> None:
        entry = [self.came, us, txn_id, cents, False]
        self.came += 1
        self.all.append(entry)
        self.classes.setdefault(self._class(cents), deque()).append(entry)

    def take(self, us: int, cents: int) -> list | None:
        """The first waiting credit that a debit of ``cents`` is within the tolerance of."""
        self.forget(us)
        best = None
        low, high = cents * PARTS / (PARTS + self.tol), cents * PARTS / max(PARTS - self.tol, 1)
        for k in range(self._class(low) - 1, self._class(high) + 2):
            row = self.classes.get(k)
            while row and row[0][4]:
                row.popleft()
            if not row:
                self.classes.pop(k, None)
                continue
            for entry in row:
                if best is not None and entry[0] > best[0]:
                    break
                if not entry[4] and abs(entry[3] - cents) * PARTS <= self.tol * entry[3]:
                    best = entry
                    break
        if best is not None:
            best[4] = True
        return best


def _scan(limit_us: int, tol: int):
    """Walk over rows sorted by account, slice and time: pairs, and per slice the credits that wait at its end."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, out, last = (None, None), Waiting(limit_us, tol), [], 0

        def left_over() -> list[tuple]:
            waiting.forget(last)
            return [(*key, e[1], e[2], e[3], None, None) for e in waiting.all if not e[4]]

        for batch in batches:
            rows = zip(*(batch[c] for c in (A, "_slice", "us", "txn_id", "cents", "credit")), strict=True)
            for account, slice_no, us, txn_id, cents, credit in rows:
                if (account, slice_no) != key:
                    out += left_over()
                    key, waiting = (account, slice_no), Waiting(limit_us, tol)
                last = us
                if credit:
                    waiting.put(us, txn_id, cents)
                elif (hit := waiting.take(us, cents)) is not None:
                    out.append((*key, hit[1], hit[2], hit[3], txn_id, us))
            yield pd.DataFrame(out, columns=COLUMNS)
            out = []
        yield pd.DataFrame(left_over(), columns=COLUMNS)

    return walk


COLUMNS = [A, "_slice", "us", "txn_id", "cents", "debit_txn_id", "debit_us"]


def passthrough_matches(
    txn: DataFrame, hours: float = 48, tol: float = 0.05, min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT_KEYS
) -> DataFrame:
    """(account_id, txn_id, debit_txn_id, passthrough_hours): credits with the debit each of them takes.

    A debit is later in (ts, txn_id), at most ``hours`` after the credit, and off by at most ``tol`` of the
    credit, in whole cents and ten-thousandths. Rows without an account, and types other than C and D, are left
    out. A task holds the credits of one account that still wait.

    Hot accounts are walked in slices of time at once. Each slice starts from the credits that waited at the end of
    the one before; this is repeated until what waits at the ends stays the same, which makes it right for the
    first slice after one round, for the second after two, and mostly for all of them then.
    """
    number, text = txn.schema["txn_id"].dataType.simpleString(), txn.schema[A].dataType.simpleString()
    schema = f"{A} {text}, _slice long, us long, txn_id {number}, cents long, debit_txn_id {number}, debit_us long"
    rows = txn.filter(F.col(A).isNotNull() & F.col("txn_type").isin("C", "D")).select(
        A, "ts", "txn_id", S.micros("ts").alias("us"), S.cents(F.abs("amount")).alias("cents"), (F.col("txn_type") == "C").alias("credit")
    )
    walk = _scan(round(hours * 3_600_000_000), round(tol * PARTS))

    def walked(df: DataFrame) -> DataFrame:
        placed = df.repartition(A, "_slice").sortWithinPartitions(A, "_slice", "_own", "us", "txn_id")
        return placed.select(A, "_slice", "us", "txn_id", "cents", "credit").mapInPandas(walk, schema)

    cold, sliced = split_hot(rows, A, ("ts", "txn_id"), hot_accounts(rows, A, "ts", min_rows, max_hot))
    found = walked(cold.drop("ts").withColumns({"_slice": F.lit(0).cast("long"), "_own": F.lit(True)}))
    if sliced is not None:
        found = found.unionByName(_hot_matches(sliced.drop("ts").withColumn("_own", F.lit(True)), walked))
    elapsed = (F.col("debit_us") - F.col("us")) / 3.6e9
    return found.filter(F.col("debit_us").isNotNull()).select(A, "txn_id", "debit_txn_id", elapsed.alias("passthrough_hours"))


def _hot_matches(sliced: DataFrame, walked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    places = cut_lineage(sliced.select(A, "_slice").distinct())
    before = None
    while True:
        rows = sliced if before is None else sliced.unionByName(before)
        found = cut_lineage(walked(rows))
        ends = found.filter(F.col("debit_us").isNull()).withColumn("_slice", F.col("_slice") + 1)
        carried = ends.join(places, [A, "_slice"], "left_semi").select(
            A, "txn_id", "us", "cents", F.lit(True).alias("credit"), "_slice", F.lit(False).alias("_own")
        )
        if before is None:
            same = carried.isEmpty()
        else:
            same = carried.count() == before.count() and carried.exceptAll(before.select(*carried.columns)).isEmpty()
        if same:
            return found
        before = carried
