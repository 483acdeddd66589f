"""Ledger views over the TPC-H-like star schema and the event table.

``lineitem_ledger`` has amounts in the structuring range and day granularity; ``event_ledger`` has
unique microsecond timestamps. Both give the operator schema
``account_id, txn_id, ts, amount (signed), txn_type, channel, counterparty_id, mcc_code``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; its schema is read from the file footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _signed(value: str) -> F.Column:
    return F.when(F.col("txn_type") == "C", F.col(value)).otherwise(-F.col(value))


def lineitem_ledger(spark: SparkSession, sf_dir: str, mcc: bool = False, mcc_list: bool = False, part_key: bool = False, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Order lines as transactions of the ordering customer; ``mcc`` adds the part join.

    ``mcc_list`` keeps every line once instead: ``mcc_codes`` is the list of its part's codes as JSON, NULL
    where ``mcc`` would drop the line. ``listed_mcc`` turns such rows into those of ``mcc``, up to repeats.
    ``part_key`` keeps the key of the part, for ``mcc_of_parts``. ``deal`` is applied to the joined lines while they are
    narrow: the columns made from them hold several of theirs twice, and the status of a line moves as one flag.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("_credit", F.col("l_linestatus") == "O")
    if mcc_list:
        codes = F.to_json(F.sort_array(F.collect_set("p_brand"))).alias("mcc_codes")
        lines = lines.join(table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(codes), "l_partkey", "left")
    if mcc:
        parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("mcc_code"))
        lines = lines.join(parts, "l_partkey")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("channel")
    )
    joined = lines.join(orders, "l_orderkey")
    txn = (deal(joined) if deal else joined).select(
        "account_id",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("txn_id"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("_credit"), "C").otherwise("D").alias("txn_type"),
        "l_extendedprice",
        "channel",
        F.col("l_suppkey").alias("counterparty_id"),
        *(["mcc_code"] if mcc else []),
        *(["mcc_codes"] if mcc_list else []),
        *([F.col("l_partkey").alias("part_key")] if part_key else []),
    )
    return txn.withColumn("amount", _signed("l_extendedprice")).drop("l_extendedprice")


def listed_mcc(txn: DataFrame) -> DataFrame:
    """A row per code of ``mcc_codes``; rows without a part are left out, parts without a code have NULL."""
    rest = [c for c in txn.columns if c != "mcc_codes"]
    return txn.filter(F.col("mcc_codes").isNotNull()).select(*rest, F.explode_outer(F.from_json("mcc_codes", "array<string>")).alias("mcc_code"))


def mcc_of_parts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with ``part_key``, once per code of their part; ``part_known`` is NULL for those without a part."""
    codes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_brand").alias("mcc_code"), F.lit(True).alias("part_known"))
    return rows.join(codes.distinct(), "part_key", "left")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as transactions; the numeric property ``k`` is the counterparty account."""
    return event_rows(table(spark, sf_dir, "events"))


def event_rows(events: DataFrame) -> DataFrame:
    """Event rows (batch or streaming) in the operator schema."""
    return (
        events.select(
            F.col("user_id").alias("account_id"),
            F.col("event_id").alias("txn_id"),
            "ts",
            F.when(F.col("event_type").isin("purchase", "signup"), "C").otherwise("D").alias("txn_type"),
            "value",
            F.col("event_type").alias("channel"),
            F.get_json_object("props", "$.k").cast("bigint").alias("counterparty_id"),
            F.col("event_type").alias("mcc_code"),
        )
        .withColumn("amount", _signed("value"))
        .drop("value")
    )


def accounts(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per customer with account dates and balances taken from its orders, which may be given laid out."""
    date = F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    dates = orders.groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.min(date).alias("opening_date"),
        F.max(F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), date)).alias("freeze_date"),
        F.max(F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), date)).alias("unfreeze_date"),
        F.max(F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH"), date)).alias("last_mobile_update_date"),
        F.max(F.when(F.col("o_orderstatus") == "O", date)).alias("last_kyc_date"),
        F.min("o_totalprice").alias("monthly_avg_balance"),
        F.max("o_totalprice").alias("quarterly_avg_balance"),
    )
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_nationkey").alias("branch_code"),
        F.when(F.col("c_acctbal") < -500, "frozen").otherwise("active").alias("account_status"),
        F.col("c_acctbal").alias("avg_balance"),
        (F.col("c_acctbal") / 10).alias("daily_avg_balance"),
        F.col("c_mktsegment").alias("scheme_code"),
    )
    return cust.join(dates, "account_id", "left")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of every customer; one fifth of the ids (by hash) plays the test set."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_nationkey").alias("branch_code"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_mule"),
        (hash_bucket("c_custkey", "split", 5) == 0).alias("is_test"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score in [0, 1] that carries some label information."""
    noise = hash_bucket("c_custkey", "score", 100000) / 100000
    lift = F.when(F.col("c_acctbal") < 0, 0.35).otherwise(0.0)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_mule"),
        F.round(noise * 0.65 + lift, 3).alias("score"),
    )


def side_ledger(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as the side ledger: balance after the transaction, location, codes; they may be given laid out."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") - 200000).alias("balance_after_transaction"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CLT_CASH")
        .when(F.col("o_orderpriority") == "2-HIGH", "LOAN")
        .otherwise(F.col("o_orderpriority"))
        .alias("transaction_sub_type"),
        F.when(F.col("o_orderstatus") == "O", "CI").when(F.col("o_orderstatus") == "F", "BI").otherwise(F.col("o_orderstatus")).alias("part_transaction_type"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 10000).alias("latitude"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 5000).alias("longitude"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 17).cast("string").alias("ip_address"),
    )


def hash_bucket(key: str, salt: str, n: int) -> F.Column:
    """Engine-independent bucket: the first 8 hex digits of md5(salt:key) modulo n."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n
