"""Monotone calibration against a plain pooling program, over many small ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgersignal.operators import isotonic as IS
from ledgersignal.operators import scoring as SC


def by_min_max(rows):
    """{score: rate} by the min-max formula, over all runs of scores."""
    points = {}
    for x, y in rows:
        n, pos = points.get(x, (0, 0))
        points[x] = (n + 1, pos + y)
    xs = sorted(points)

    def mean(a, b):
        return sum(points[x][1] for x in xs[a : b + 1]) / sum(points[x][0] for x in xs[a : b + 1])

    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.fixture()
def many_ranges(spark):
    """Every range of the layout is its own partition, so that blocks merge over two levels."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,distinct,rows", [(1, 60, 150), (2, 60, 60), (3, 5, 80)])
def test_equal_to_the_min_max_formula(spark, many_ranges, seed, distinct, rows):
    draw = random.Random(seed)
    data = [(i, draw.randrange(distinct) / distinct, int(draw.random() < 0.4)) for i in range(rows)]
    df = spark.createDataFrame(data, "account_id long, s double, is_mule int")
    want = by_min_max([(s, y) for _, s, y in data])
    got = SC.calibrate_isotonic(df, "s").collect()
    assert len(got) == rows
    assert all(r["calibrated"] == pytest.approx(want[r["s"]], abs=1e-12) for r in got)


def test_falling_rates_are_one_block_and_rising_ones_stay(spark, many_ranges):
    falling = spark.range(50).select((F.col("id") / 50).alias("s"), (F.col("id") < 20).cast("int").alias("is_mule"))
    blocks = IS.fit_isotonic(falling, "s", "is_mule").collect()
    assert [(b["n"], b["rate"]) for b in blocks] == [(50, 0.4)]
    rising = falling.withColumn("is_mule", 1 - F.col("is_mule"))
    blocks = IS.fit_isotonic(rising, "s", "is_mule").orderBy("lo").collect()
    assert [(b["n"], b["rate"], b["next_rate"]) for b in blocks] == [(20, 0.0, 1.0), (30, 1.0, None)]


def test_new_scores_lie_on_the_line_between_blocks(spark):
    fit = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1)], "s double, y int")
    steps = IS.fit_isotonic(fit, "s", "y")
    asked = spark.createDataFrame([(-1.0,), (0.3,), (0.4,), (0.5,), (0.55,), (0.7,), (9.0,), (None,), (float("nan"),)], "s double")
    got = {str(r["s"]): r["c"] for r in IS.apply_isotonic(asked, "s", steps, "c").collect()}
    want = {"-1.0": 0.0, "0.3": 0.0, "0.4": 0.0, "0.5": 0.5, "0.55": 0.75, "0.7": 1.0, "9.0": 1.0, "None": None, "nan": None}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_empty_tables_missing_labels_and_clashing_columns(spark):
    df = spark.createDataFrame([(0.5, None, 7), (None, 1, 8)], "s double, is_mule int, n int")
    out = SC.calibrate_isotonic(df, "s").collect()
    assert len(out) == 2 and {r["calibrated"] for r in out} == {None} and {r["n"] for r in out} == {7, 8}
    assert SC.calibrate_isotonic(df.filter("false"), "s").count() == 0


def test_hot_scores_take_the_broadcast_way_and_agree(spark, monkeypatch):
    df = spark.range(300).select(F.when(F.col("id") < 200, 0.0).otherwise(F.col("id") / 300).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("is_mule"), "id")
    plain = {r["id"]: r["calibrated"] for r in SC.calibrate_isotonic(df, "s").collect()}
    full = IS.lookup_by_key
    monkeypatch.setattr(IS, "lookup_by_key", lambda rows, table, key: full(rows, table, key, min_rows=20))
    assert {r["id"]: r["calibrated"] for r in SC.calibrate_isotonic(df, "s").collect()} == plain


def test_out_of_fold_calibration_ignores_the_own_fold(spark):
    df = spark.range(90).select("id", (F.col("id") / 90).alias("s"), (F.col("id") >= 45).cast("int").alias("is_mule"), (F.col("id") % 3).alias("fold"))
    base = {r["id"]: r["calibrated"] for r in SC.calibrate_oof(df, "s", 3).collect()}
    turned = df.withColumn("is_mule", F.when(F.col("fold") == 0, 1 - F.col("is_mule")).otherwise(F.col("is_mule")))
    other = {r["id"]: r["calibrated"] for r in SC.calibrate_oof(turned, "s", 3).collect()}
    assert len(base) == 90 and all(base[i] == other[i] for i in base if i % 3 == 0)


def test_choice_takes_the_highest_auc(spark):
    df = spark.range(40).select(F.col("id").alias("account_id"), (F.col("id") >= 20).cast("int").alias("is_mule"), (-F.col("id")).alias("bad"), F.col("id").alias("good"))
    out = SC.choose_by_auc(df, ["bad", "good"]).collect()
    assert {r["choice"] for r in out} == {"good"} and all(r["score"] == r["account_id"] for r in out)
