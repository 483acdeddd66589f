"""What several operators share: reading, keys, size-checked broadcasts and sorted group walks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersignal.session import ensure_checkpoint_dir

#: Rows that a Python function gets at once. Texts may be long, so batches are smaller than Spark's own.
BATCH_ROWS = 1_000
#: Rows up to which a table of small rows (some hundred bytes at most) may be broadcast.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit key of a text: equal texts, equal keys."""
    return F.unhex(F.md5(text.cast("binary")))


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the memory of Python functions over texts, for this session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows stay within ``rows``, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the shared checkpoint folder and go on from there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Rows = dict[str, np.ndarray]


def walk_groups(batches: Iterator[pd.DataFrame], key: list[str], each: Callable[[Rows], Rows | None]) -> Iterator[pd.DataFrame]:
    """Apply ``each`` to every run of rows with equal ``key``; rows must come sorted by it.

    Groups are slices of column arrays. Many small groups share one batch of output, which per-group calls of
    Spark would not.
    """
    rest: pd.DataFrame | None = None

    def run(table: pd.DataFrame, last: bool) -> tuple[list[Rows], pd.DataFrame | None]:
        columns = {c: table[c].to_numpy() for c in table.columns}
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in key:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        starts = np.append(np.nonzero(new)[0], len(table))
        ends = starts if last else starts[:-1]
        found = [each({c: v[a:b] for c, v in columns.items()}) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [f for f in found if f is not None], None if last else table.iloc[starts[-2] :]

    for batch in batches:
        table = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(table):
            continue
        done, rest = run(table, False)
        if done:
            yield pd.DataFrame({c: np.concatenate([d[c] for d in done]) for c in done[0]})
    if rest is not None and len(rest):
        done, _ = run(rest, True)
        if done:
            yield pd.DataFrame({c: np.concatenate([d[c] for d in done]) for c in done[0]})
