"""Reading batch folders, hand-off files and saved models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgersignal.operators import reports as RE
from ledgersignal.operators import scoring as SC
from ledgersignal.sources import readers as RD


def test_batch_folders_are_one_ledger(spark, scratch):
    rows = [("t1", "a", "2024-01-02 03:04:05", 10.5, "C", "UPI", "x", "5411"), ("t2", "a", "02/01/2024", -3.0, "D", "UPI", None, None), ("t3", "b", "bad", 1.0, "C", "ATM", "y", "1")]
    df = spark.createDataFrame(rows, RD.LEDGER_SCHEMA)
    for i in (1, 2):
        df.filter((F.col("transaction_id") == "t3") == (i == 2)).write.parquet(f"{scratch}/transactions/batch-{i}")
    raw = RD.read_ledger(spark, scratch, schema=RD.LEDGER_SCHEMA)
    assert raw.count() == 3
    assert RD.read_ledger(spark, scratch, ["account_id", "amount"]).columns == ["account_id", "amount"]
    ts = {r["txn_id"]: r["ts"] for r in RD.standard_ledger(raw, ["dd/MM/yyyy"]).collect()}
    assert ts["t1"] == dt.datetime(2024, 1, 2, 3, 4, 5) and ts["t2"] == dt.datetime(2024, 1, 2) and ts["t3"] is None


def test_dims_by_name(spark, scratch):
    spark.createDataFrame([("a", "2024-01-05"), ("b", "none")], "account_id string, opened string").write.parquet(f"{scratch}/accounts.parquet")
    dims = RD.read_dims(spark, scratch, ["accounts"], typed=False)
    got = {r[0]: r[1] for r in RD.parse_dates(dims["accounts"], ["opened"]).collect()}
    assert got == {"a": dt.date(2024, 1, 5), "b": None}


def test_features_and_submission_round_trip(spark, scratch):
    feat = spark.createDataFrame([("a", 1.5), ("b", None)], "account_id string, x double")
    RD.write_features(feat, f"{scratch}/f")
    RD.write_features(feat, f"{scratch}/c", "csv")
    assert sorted(RD.read_features(spark, f"{scratch}/f").collect()) == sorted(feat.collect())
    assert RD.read_features(spark, f"{scratch}/c", "csv", feat.schema).count() == 2
    test = spark.createDataFrame([("a",), ("b",)], "account_id string")
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "account_id string, score double")
    windows = spark.createDataFrame([("a", 19723, 19724)], "account_id string, start_day bigint, end_day bigint")
    sub = RE.assemble_submission(test, scores, windows)
    RD.write_submission(sub.coalesce(1), f"{scratch}/s")
    text = {line.strip() for r in spark.read.text(f"{scratch}/s").collect() for line in [r[0]]}
    assert text == {"account_id,score,suspicious_start,suspicious_end", "a,0.9,2024-01-01T00:00:00,2024-01-02T23:59:59", "b,0.1,,"}


def test_samples_keep_whole_accounts(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("account_id"), "id")
    part = RD.sample_accounts(df, 1, 3)
    kept = part.select("account_id").distinct().count()
    assert 0 < kept < 50 and part.count() == kept * 20


def test_models_can_be_saved(spark, scratch):
    df = spark.createDataFrame([(str(i), float(i % 7), i % 7 > 3) for i in range(60)], "account_id string, x double, b boolean").withColumn("is_mule", F.col("b").cast("int"))
    data = SC.vectorised(df, ["x"])
    model = SC.pipeline(SC.estimators(trees=3)["linear"]()).fit(data)
    RD.save_model(model, f"{scratch}/m")
    again = RD.load_model(f"{scratch}/m")
    assert SC.probability(again.transform(data), "p").collect() == SC.probability(model.transform(data), "p").collect()
