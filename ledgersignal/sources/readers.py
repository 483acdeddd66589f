"""Reading ledgers and dimension tables, parsing, and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersignal.functions.scalars import iso_window_from_day_no
from ledgersignal.sources.adapters import hash_bucket

DIM_FILES = {
    "customers": "customers.parquet",
    "accounts": "accounts.parquet",
    "linkage": "customer_account_linkage.parquet",
    "products": "product_details.parquet",
    "labels": "train_labels.parquet",
    "test_accounts": "test_accounts.parquet",
    "demographics": "demographics.parquet",
    "accounts_additional": "accounts-additional.parquet",
    "branch": "branch.parquet",
}

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("transaction_timestamp", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("txn_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("counterparty_id", T.StringType()),
        T.StructField("mcc_code", T.StringType()),
    ]
)


SIDE_LEDGER_SCHEMA = (
    "transaction_id string, ip_address string, latitude double, longitude double, balance_after_transaction double, "
    "transaction_sub_type string, part_transaction_type string"
)

DIM_SCHEMAS = {
    "customers": "customer_id string, date_of_birth string, relationship_start_date string, aadhaar_available string",
    "accounts": "account_id string, branch_code string, account_opening_date string, freeze_date string, unfreeze_date string, "
    "last_mobile_update_date string, last_kyc_date string, account_status string, avg_balance double, daily_avg_balance double, "
    "monthly_avg_balance double, quarterly_avg_balance double",
    "linkage": "customer_id string, account_id string",
    "labels": "account_id string, is_mule int, mule_flag_date string, alert_reason string",
    "test_accounts": "account_id string",
    "demographics": "customer_id string, joint_account_flag string, nri_flag string, gender string, phone_number string, address string, "
    "address_last_update_date string, passbook_last_update_date string",
    "accounts_additional": "account_id string, scheme_code string",
    "products": "product_code string, product_name string, product_type string",
    "branch": "branch_code string, branch_type string, branch_employee_count string, branch_turnover string, branch_asset_size string",
}


def read_dims(spark: SparkSession, path: str, names: Sequence[str] | None = None, typed: bool = True) -> dict[str, DataFrame]:
    """The static tables by name, with fixed schemas so that no file is opened to infer one.

    ``typed=False`` takes the types from the files, for tables stored with other types.
    """

    def read(name: str) -> DataFrame:
        schema = DIM_SCHEMAS.get(name) if typed else None
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(f"{path}/{DIM_FILES[name]}")

    return {n: read(n) for n in (names or DIM_FILES)}


def read_ledger(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    table: str = "transactions",
) -> DataFrame:
    """All ``batch-*`` folders of a ledger as one scan; ``columns`` prunes the parquet read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/batch-*")
    return df.select(*columns) if columns else df


def standard_ledger(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Raw ledger columns renamed to the operator schema (``txn_id``, ``ts``)."""
    ts = parse_mixed_ts("transaction_timestamp", formats)
    return raw.withColumn("ts", ts).withColumnRenamed("transaction_id", "txn_id").drop("transaction_timestamp")


def scan_for_accounts(txn: DataFrame, ids: DataFrame | Sequence, key: str = "account_id") -> DataFrame:
    """Restrict a ledger to some accounts.

    A table of ids becomes a semi-join that AQE turns into a broadcast only when its measured size allows
    it. A list of literals is the caller's choice to push the ids to the parquet reader, at any length.
    """
    if isinstance(ids, DataFrame):
        return txn.join(ids.select(key).distinct(), key, "left_semi")
    return txn.filter(F.col(key).isin(list(ids)))


def sample_accounts(txn: DataFrame, keep: int, out_of: int, key: str = "account_id", salt: str = "sample") -> DataFrame:
    """Deterministic sample of whole accounts, so that no account sequence is cut. Every engine draws the same."""
    return txn.filter(hash_bucket(key, salt, out_of) < keep)


def parse_dates(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text to DATE, bad values to NULL."""
    def parse(c: str) -> Column:
        if fmt:
            return F.to_date(F.try_to_timestamp(F.col(c), F.lit(fmt)))
        return F.col(c).try_cast("date")

    return df.withColumns({c: parse(c) for c in columns})


def parse_mixed_ts(column: str, formats: Sequence[str] = ()) -> Column:
    """First format that parses wins; the default parser is the last resort."""
    c = F.col(column)
    attempts = [F.try_to_timestamp(c, F.lit(f)) for f in formats] + [c.try_cast("timestamp")]
    return F.coalesce(*attempts)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def universe(labels: DataFrame, test: DataFrame, key: str = "account_id") -> DataFrame:
    return labels.select(key).union(test.select(key)).distinct()


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.csv(path, header=True, inferSchema=schema is None)


def write_submission(df: DataFrame, path: str) -> None:
    """CSV with header; a missing window is written as an empty field."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def submission_rows(scores: DataFrame, windows: DataFrame, key: str = "account_id") -> DataFrame:
    start, end = iso_window_from_day_no("start_day", "end_day")
    text = windows.select(key, start.alias("suspicious_start"), end.alias("suspicious_end"))
    return scores.join(text, key, "left").fillna("", subset=["suspicious_start", "suspicious_end"])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
