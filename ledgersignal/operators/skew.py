"""Building blocks that keep one hot key from landing in one task.

* ``hot_keys`` lists every key with more than ``min_rows`` rows. Of N rows these are at most
  N / min_rows keys, half a million for 10**12 rows, so the list may be broadcast; its size is counted,
  and only beyond ``max_hot`` keys the list keeps the most frequent ones.
* ``lookup_by_key`` joins rows to a per-key table: hot keys by broadcast, all others by an ordinary
  join whose strategy AQE picks from measured sizes. Rows whose key the table lacks stay under ``left``,
  hot or not.
* ``with_neighbours`` is lag/lead over an ordered account sequence. The rows of hot accounts are laid out
  by range of (account, order), so slices hold about equally many rows whatever their times are, and even
  one instant is split; the few rows at slice borders are then fixed up.
* ``next_match`` finds the next later row that satisfies a condition, with the same slicing.

The hot keys are looked up first (one count over the key column); when there are none, the plan is
the ordinary one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.session import cut_lineage

MIN_HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 1_000_000
BOUND_BUCKETS = 65_536


def hot_keys(counts: DataFrame, n: str = "n", min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """The keys of a (key, n) table with more than ``min_rows`` rows, written once.

    Should there be more than ``max_hot`` of them, the most frequent ones: a key outside the list then has
    less than ``1/max_hot`` of all rows, which an ordinary task can take, and goes the ordinary way.
    """
    hot = cut_lineage(counts.filter(F.col(n) > min_rows))
    return hot if hot.count() <= max_hot else cut_lineage(hot.orderBy(F.col(n).desc()).limit(max_hot))


def fetch_hot(counts: DataFrame, keys: Sequence[str], n: str = "n", min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT_KEYS) -> DataFrame | None:
    """The hot keys as a table of at most ``max_hot`` rows, or None without any."""
    hot = hot_keys(counts.filter(F.col(n) > min_rows).select(*keys, n), n, min_rows, max_hot).select(*keys)
    return None if hot.isEmpty() else hot


def salted_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], salts: int = 64) -> DataFrame:
    """Inner join on few but very frequent keys: rows are spread over salts, ``per_key`` repeated.

    Used for hot keys whose right side has many rows and may therefore not be broadcast.
    """
    others = [c for c in rows.columns if c not in keys]
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*(others or keys)), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"]).drop("_salt")


def lookup_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str | Sequence[str],
    n: str = "n",
    how: str = "left",
    min_rows: int = MIN_HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
    counts: DataFrame | None = None,
    small: bool = True,
) -> DataFrame:
    """Join ``rows`` to ``per_key``, where ``per_key.n`` is the number of rows of each key.

    ``counts`` may give (key, n) from a cheaper source than ``per_key``. ``n`` is dropped from the
    result. Rows with a NULL key keep NULLs under ``left``. Without hot keys this is one plain join.
    ``small`` says that a key has one short row in ``per_key``, so that the rows of the hot keys may
    be broadcast (at most ``max_hot``); otherwise they are joined by salt (``how`` = inner).
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = fetch_hot(per_key if counts is None else counts, keys, n, min_rows, max_hot)
    values = per_key.drop(n)
    if hot is None:
        return rows.join(values, keys, how)
    hot_values = values.join(F.broadcast(hot), keys, "left_semi")
    hot_rows = rows.join(F.broadcast(hot), keys, "left_semi")
    hot_part = hot_rows.join(F.broadcast(hot_values), keys, how) if small else salted_join(hot_rows, hot_values, keys)
    cold_part = rows.join(F.broadcast(hot), keys, "left_anti").join(values, keys, how)
    return hot_part.unionByName(cold_part)


@dataclass(frozen=True)
class HotAccounts:
    """Hot accounts of a ledger and the number of slices for all their rows; ``table`` is None without any.

    May be shared by all operators over the same ledger, filtered or not.
    """

    table: DataFrame | None
    slices: int = 0


def hot_accounts(txn: DataFrame, key: str = "account_id", ts: str = "ts", min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT_KEYS) -> HotAccounts:
    """Find hot accounts: one count over the key column, reused by every branch. Slices have about half of ``min_rows`` rows."""
    hot = hot_keys(txn.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n", min_rows, max_hot)
    rows = hot.agg(F.sum("n")).first()[0]
    return HotAccounts(hot.select(key), 2 * -(-rows // min_rows)) if rows else HotAccounts(None)


def most_rows(df: DataFrame, key: str) -> int:
    """Rows of the most frequent key; 0 without any key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def most_rows_bound(df: DataFrame, key: str, buckets: int = BOUND_BUCKETS) -> int:
    """No key has more rows than this: the rows of the fullest bucket of keys.

    A task sends a row per bucket instead of a row per key, however many keys there are.
    """
    return most_rows(df.filter(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")), "_bucket")


def split_hot(txn: DataFrame, key: str, order: Sequence[str], hot: HotAccounts) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary accounts, rows of hot accounts with a ``_slice`` number or None).

    Slices are range partitions of (account, order), numbered upwards. They are written, because several
    windows must see the same numbers.
    """
    if hot.table is None:
        return txn, None
    cold = txn.join(F.broadcast(hot.table), key, "left_anti")
    ranged = txn.join(F.broadcast(hot.table), key, "left_semi").repartitionByRange(hot.slices, key, *order)
    return cold, cut_lineage(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint")))


def with_neighbours(
    txn: DataFrame,
    shifts: dict[str, tuple[Column | str, int]],
    key: str = "account_id",
    order: Sequence[str] = ("ts", "txn_id"),
    hot: HotAccounts | None = None,
    min_rows: int = MIN_HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Add ``{name: (expression, offset)}`` columns; positive offsets look back, negative ahead."""
    reach = max(abs(k) for _, k in shifts.values())

    def shifted(w):
        return {name: F.lag(e, k).over(w) if k > 0 else F.lead(e, -k).over(w) for name, (e, k) in shifts.items()}

    def window(*keys):
        return Window.partitionBy(*keys).orderBy(*order)

    cold, sliced = split_hot(txn, key, order, hot or hot_accounts(txn, key, order[0], min_rows, max_hot))
    result = cold.withColumns(shifted(window(key)))
    if sliced is None:
        return result

    per_slice = window(key, "_slice")
    marked = sliced.withColumns({"_rn": F.row_number().over(per_slice), "_more": F.lead(F.lit(1), reach).over(per_slice)})
    settled = (F.col("_rn") > reach) & F.col("_more").isNotNull()
    inner = marked.withColumns(shifted(per_slice)).filter(settled)
    # Rows near a slice end are ordered again across slices. They form runs of at most 4*reach rows
    # per slice, so this second sort is small however large the account is.
    wide = _borders(sliced, per_slice, reach)
    border = wide.withColumns(shifted(window(key))).filter(F.col("_border"))
    helper = ["_slice", "_rn", "_more", "_border"]
    return result.unionByName(inner.drop(*helper)).unionByName(border.drop(*helper))


def _borders(hot: DataFrame, per_slice, reach: int) -> DataFrame:
    """Rows within ``2*reach`` of a slice end; ``_border`` marks those within ``reach``."""
    flagged = hot.withColumns(
        {
            "_rn": F.row_number().over(per_slice),
            "_near": F.lead(F.lit(1), reach).over(per_slice),
            "_far": F.lead(F.lit(1), 2 * reach).over(per_slice),
        }
    )
    near = (F.col("_rn") <= reach) | F.col("_near").isNull()
    far = (F.col("_rn") <= 2 * reach) | F.col("_far").isNull()
    return flagged.withColumn("_border", near).filter(far).drop("_near", "_far")


def next_match(
    txn: DataFrame,
    condition: Column,
    value: Column,
    name: str,
    key: str = "account_id",
    order: Sequence[str] = ("ts", "txn_id"),
    hot: HotAccounts | None = None,
    min_rows: int = MIN_HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Add ``name``: ``value`` of the nearest strictly later row where ``condition`` holds.

    Scanning in descending order makes the frame grow from its start, which costs one pass.
    """
    hit = F.when(condition, value)
    descending = [F.col(c).desc() for c in order]

    def window(*keys):
        return Window.partitionBy(*keys).orderBy(*descending).rowsBetween(Window.unboundedPreceding, -1)

    cold, sliced = split_hot(txn, key, order, hot or hot_accounts(txn, key, order[0], min_rows, max_hot))
    result = cold.withColumn(name, F.last(hit, ignorenulls=True).over(window(key)))
    if sliced is None:
        return result

    order_struct = F.struct(*order)
    firsts = sliced.filter(condition).groupBy(key, "_slice").agg(F.min_by(value, order_struct).alias("_first"))
    every = sliced.select(key, "_slice").distinct().join(firsts, [key, "_slice"], "left")
    slices_after = Window.partitionBy(key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carry", F.last("_first", ignorenulls=True).over(slices_after)).drop("_first")
    inside = sliced.withColumn(name, F.last(hit, ignorenulls=True).over(window(key, "_slice")))
    fixed = inside.join(carried, [key, "_slice"], "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_slice")
    return result.unionByName(fixed)
