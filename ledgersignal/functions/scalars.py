"""Row-level expressions over ledger columns (all JVM-side, no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The amount sets and limits that define structuring and size flags.
ROUND_AMOUNTS = (1000, 5000, 10000, 50000, 100000)
EXACT_ROUND_AMOUNTS = (1000, 5000, 10000, 50000)
NEAR_THRESHOLD = (45000, 50000)
STRUCT_48_50 = (48000, 50000)
SMALL_AMOUNT = 500
LARGE_AMOUNT = 50000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Whole microseconds since 1970 for TIMESTAMP or TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, col(ts).cast("timestamp_ntz"))


def with_ledger_cols(txn: DataFrame) -> DataFrame:
    """abs amount, integer cents and the calendar parts that the feature groups use."""
    day = F.to_date("ts")
    return txn.withColumns(
        {
            "abs_amount": F.abs("amount"),
            "cents": cents(F.abs("amount")),
            "day": day,
            "day_no": F.unix_date(day).cast("bigint"),
            "hour": F.hour("ts"),
            "day_of_month": F.dayofmonth("ts"),
            "is_weekend": F.dayofweek("ts").isin(1, 7),
            "month": F.trunc(day, "MM"),
        }
    )


def cents(amount: Column | str) -> Column:
    """Money as integer cents, so that sums do not depend on the order of rows."""
    return F.round(col(amount) * 100).cast("bigint")


def in_band(amount: Column | str, lo: float, hi: float) -> Column:
    return (col(amount) >= lo) & (col(amount) < hi)


def near_threshold(amount: Column | str, lo: float = NEAR_THRESHOLD[0], hi: float = NEAR_THRESHOLD[1]) -> Column:
    return in_band(amount, lo, hi)


def struct_band_48_50(amount: Column | str) -> Column:
    return in_band(amount, *STRUCT_48_50)


def struct_band_45_50(amount: Column | str) -> Column:
    return in_band(amount, *NEAR_THRESHOLD)


def is_round_amount(amount: Column | str, values: Iterable[float] = ROUND_AMOUNTS) -> Column:
    return col(amount).isin([float(v) for v in values])


def is_exact_round(amount: Column | str) -> Column:
    return is_round_amount(amount, EXACT_ROUND_AMOUNTS)


def is_large_round(amount: Column | str, floor: float = 10000, step: float = 1000) -> Column:
    return (col(amount) >= floor) & (col(amount) % step == 0)


def is_small(amount: Column | str, limit: float = SMALL_AMOUNT) -> Column:
    return col(amount) < limit


def is_large(amount: Column | str, limit: float = LARGE_AMOUNT) -> Column:
    return col(amount) > limit


def is_large_ge(amount: Column | str, limit: float = LARGE_AMOUNT) -> Column:
    return col(amount) >= limit


def is_night(hour: Column | str = "hour", before: int = 6) -> Column:
    return col(hour) < before


def is_month_boundary(day_of_month: Column | str = "day_of_month") -> Column:
    return (col(day_of_month) <= 5) | (col(day_of_month) >= 26)


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(col(ts)).isin(1, 7)


def safe_ratio(num: Column | str, den: Column | str, floor: float = 1) -> Column:
    """``num / max(den, floor)`` where a missing denominator stays missing."""
    d = col(den)
    return col(num) / F.when(d.isNull(), F.lit(None)).otherwise(F.greatest(d.cast("double"), F.lit(float(floor))))


def action_code(txn_type: Column | str = "txn_type", channel: Column | str = "channel") -> Column:
    return F.concat_ws("_", F.coalesce(col(txn_type), F.lit("nan")), F.coalesce(col(channel), F.lit("nan")))


def flag_eq(c: Column | str, value) -> Column:
    return F.coalesce((col(c) == value).cast("int"), F.lit(0))


def flag_present(c: Column | str) -> Column:
    return col(c).isNotNull().cast("int")


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """0/1 columns for a fixed category list."""
    return df.withColumns({f"{prefix}_{v}": flag_eq(column, v) for v in values})


def log_amount(amount: Column | str) -> Column:
    return F.log1p(F.abs(col(amount)))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; missing stays missing."""
    out = c = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def iso_window(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """Interval bounds as text: start of the first day, last second of the last day."""
    s, e = col(start), col(end)
    return (
        F.concat(F.date_format(s, "yyyy-MM-dd"), F.lit("T00:00:00")),
        F.concat(F.date_format(e, "yyyy-MM-dd"), F.lit("T23:59:59")),
    )


def iso_window_from_day_no(start: str, end: str) -> tuple[Column, Column]:
    return iso_window(F.date_from_unix_date(F.col(start).cast("int")), F.date_from_unix_date(F.col(end).cast("int")))


def rounded_location(lat: Column | str, lon: Column | str, digits: int = 3) -> Column:
    """Grid cell of a coordinate pair, missing unless both parts are known."""
    lat, lon = col(lat), col(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.bround(lat, digits), F.bround(lon, digits)))


def total_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def exclude_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_degenerate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop numeric columns that hold fewer than two distinct values; others stay.

    One pass with one small row of results per call: min and max differ exactly when a column has
    more than one value.
    """
    varied = df.agg(*[(F.max(c) != F.min(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not varied[c]])


def impute_constant(df: DataFrame, columns: Sequence[str], value: float) -> DataFrame:
    return df.fillna(value, subset=list(columns))
