"""From raw bank files to a submission on a small invented bank."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgersignal.operators import scoring as SC
from ledgersignal.plans import bank_features as BF
from ledgersignal.sources import readers as RD

ACCOUNTS = [f"ACCT_{i:03d}" for i in range(60)]
MULES = set(ACCOUNTS[::4])


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bank"))
    rnd = random.Random(11)
    txn, side = [], []
    for a in ACCOUNTS:
        start = dt.datetime(2023, 1, 1) + dt.timedelta(days=rnd.randrange(100))
        for j in range(30):
            burst = a in MULES and j < 20
            ts = start + (dt.timedelta(days=200, hours=j) if burst else dt.timedelta(days=rnd.randrange(300), minutes=rnd.randrange(900)))
            amount = rnd.choice([49000.0, 60000.0]) if burst else rnd.choice([300.0, 1000.0, 52000.0])
            kind = "C" if j % 2 else "D"
            tid = f"{a}-{j}"
            txn.append((tid, a, ts.strftime("%Y-%m-%d %H:%M:%S"), amount if kind == "C" else -amount, kind, rnd.choice(["UPI", "ATM"]), f"CP_{rnd.randrange(15)}", rnd.choice(["5411", "6011", None])))
            side.append((tid, f"10.0.0.{rnd.randrange(4)}", rnd.random() * 10, rnd.random() * 10, rnd.random() * 1000 - 500, "CLT_CASH", "CI"))
    frames = spark.createDataFrame(txn, RD.LEDGER_SCHEMA), spark.createDataFrame(side, RD.SIDE_LEDGER_SCHEMA)
    for name, df in zip(("transactions", "transactions_additional"), frames, strict=True):
        for b in (0, 1):
            df.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(2)) == b).write.parquet(f"{path}/{name}/batch-{b}")
    dims = {
        "accounts": [(a, f"B{i % 5}", "2022-06-01", "2023-09-01" if a in MULES else None, None, "2023-01-01" if i % 3 else None, "bad", "active", 100.0, 10.0, 90.0, 110.0) for i, a in enumerate(ACCOUNTS)],
        "customers": [(f"C{i}", None, None, "Y" if i % 2 else None) for i in range(60)],
        "linkage": [*((f"C{i}", a) for i, a in enumerate(ACCOUNTS)), ("C1", ACCOUNTS[0])],
        "labels": [(a, int(a in MULES), None, None) for a in ACCOUNTS[:45]],
        "test_accounts": [(a,) for a in ACCOUNTS[45:]],
        "demographics": [(f"C{i}", "Y", "N", "M", f"P{i // 3}", None, None, None) for i in range(60)],
        "accounts_additional": [(a, "PMJDY" if i % 2 else "X") for i, a in enumerate(ACCOUNTS)],
        "products": [("PMJDY", "basic account", "savings")],
        "branch": [(f"B{i}", "urban" if i % 2 else "rural", "12", "n/a", "5.5") for i in range(5)],
    }
    for name, rows in dims.items():
        spark.createDataFrame(rows, RD.DIM_SCHEMAS[name]).write.parquet(f"{path}/{RD.DIM_FILES[name]}")
    return path


def test_bank_to_submission(spark, bank):
    txn = RD.standard_ledger(RD.read_ledger(spark, bank, schema=RD.LEDGER_SCHEMA))
    side = RD.read_ledger(spark, bank, schema=RD.SIDE_LEDGER_SCHEMA, table="transactions_additional")
    dims = RD.read_dims(spark, bank, list(RD.DIM_SCHEMAS))
    feat = BF.bank_features(txn, side, dims, "2024-01-01", folds=3).cache()
    assert feat.count() == 60 and feat.select("account_id").distinct().count() == 60
    row = feat.filter(F.col("account_id") == ACCOUNTS[4]).first()
    assert row["txn_count"] == 30 and row["has_prior_freeze"] == 1 and row["cash_txn_pct"] == 1.0 and row["shared_phone_count"] == 3
    assert row["kyc_age_days"] == 9999 and row["branch_turnover"] is None and row["scheme_PMJDY"] == 0 and row["fold"] in (0, 1, 2)
    names = BF.numeric_features(feat)
    assert {"near_threshold_pct", "gap_cv", "composite_score", "mcc_zscore_max"} <= set(names) and "branch_mule_rate" not in names
    sub = BF.score_and_locate(feat, txn, SC.estimators(trees=5)["forest"], names, 3).collect()
    assert {r["account_id"] for r in sub} == set(ACCOUNTS[45:])
    found = {r["account_id"] for r in sub if r["suspicious_start"]}
    assert MULES & set(ACCOUNTS[45:]) <= found
    assert all(0 <= r["score"] <= 1 for r in sub)
