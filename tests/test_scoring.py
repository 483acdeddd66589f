"""Model scoring: folds, calibration, funnels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgersignal.operators import evaluate as EV
from ledgersignal.operators import scoring as SC


@pytest.fixture(scope="module")
def table(spark):
    h = lambda s: F.pmod(F.xxhash64("account_id", F.lit(s)), F.lit(1000)) / 1000
    df = spark.range(400).select(F.col("id").alias("account_id")).withColumn("is_mule", (h(1) < 0.3).cast("int"))
    df = df.withColumn("x", F.col("is_mule") + h(2) * 1.5).withColumn("z", h(3)).withColumn("fold", F.col("account_id") % 3)
    return df.cache()


def test_oof_scores_every_row_once(spark, table):
    data = SC.vectorised(table, ["x", "z"])
    oof, held = SC.oof_scores(data, SC.estimators(trees=5)["linear"], 3, test=data.drop("fold", "label", "weight"))
    assert oof.count() == 400 and oof.select("account_id").distinct().count() == 400
    assert held.count() == 400
    assert EV.auc(table.join(oof, "account_id"), "oof").first()["auc"] > 0.7


def test_seed_average_writes_the_vectors_once(spark, table, monkeypatch):
    written = []
    plain = SC.cut_lineage
    monkeypatch.setattr(SC, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    makers = [SC.estimators(seed=s, trees=3)["forest"] for s in (1, 2)]
    out = SC.seed_average(SC.vectorised(table, ["x", "z"]), makers, 2)
    assert sum("features" in columns for columns in written) == 1
    assert out.count() == table.filter("fold < 2").count()


def test_red_herring_column_is_found(spark, table):
    assert SC.red_herring_columns(table.withColumn("leak", F.col("is_mule") * 2.0), ["x", "z", "leak"]) == ["leak"]


def test_calibration_is_monotone_and_bounded(spark, table):
    out = SC.calibrate_isotonic(table, "x").orderBy("x").select("calibrated").collect()
    values = [r[0] for r in out]
    assert values == sorted(values) and 0 <= values[0] <= values[-1] <= 1


def test_funnel_scores_zero_below_the_gate(spark, table):
    out = SC.two_stage_funnel(table.withColumn("s1", F.col("x") / 3), "s1", ["x", "z"], SC.estimators(trees=5)["linear"], 0.2)
    joined = out.join(table, "account_id")
    assert joined.filter((F.col("x") / 3 <= 0.2) & (F.col("funnel_score") != 0)).count() == 0
    assert out.filter("funnel_score > 0").count() > 0


def test_auc_weights():
    w = SC.auc_weights({"a": 0.9, "b": 0.8})
    assert w["a"] == pytest.approx(0.75, abs=1e-6) and w["b"] == pytest.approx(0.25, abs=1e-6)


def test_screening_and_weights(spark):
    df = spark.createDataFrame([("a", 1, 0.01, 5), ("b", 1, 0.05, 1), ("c", 1, 0.05, 4), ("d", 0, 0.9, 0), ("e", 1, 0.12, 2)], "account_id string, is_mule int, oof double, multi_signal_count int")
    kept = {r[0] for r in SC.screen_red_herrings(df, moderate=0.10, n_signals="multi_signal_count").select("account_id").collect()}
    assert kept == {"c", "d", "e"}
    v2 = {r["account_id"]: r["sample_weight"] for r in SC.soft_weights(df, "v2").collect()}
    assert v2 == {"a": 1.0, "b": 0.3, "c": 0.3, "d": 0.3, "e": 1.0}
    v7 = {r["account_id"]: r["sample_weight"] for r in SC.soft_weights(df, "v7").collect()}
    assert v7 == {"a": 1.0, "b": 0.5, "c": 1.0, "d": 1.0, "e": 0.5}


def test_learned_dampen_is_skipped_without_both_classes(spark, table):
    out = SC.learned_dampen(table.withColumn("oof", F.lit(0.9)), ["x"], "z", 0.5, SC.estimators(trees=3)["linear"])
    assert out.filter(F.col("dampened") != F.col("z")).count() == 0


def test_best_candidate(spark, table):
    assert SC.best_by_auc(table, ["z", "x"]) == "x"


def test_better_blend_keeps_the_higher_auc(spark, table):
    df = SC.better_blend(table, {"x": 0.1, "z": 0.9})
    best = EV.auc(df, "blend").first()["auc"]
    fixed = EV.auc(SC.blend(table, {"x": 0.1, "z": 0.9}), "blend").first()["auc"]
    auto = EV.auc(SC.auc_weighted_blend(table, ["x", "z"]), "blend").first()["auc"]
    assert best == pytest.approx(max(fixed, auto))


def test_halving_keeps_the_best_setting_and_repeats_itself(spark, table):
    settings = SC.random_settings({"maxDepth": [1, 4], "subsamplingRate": (0.5, 1.0)}, 4, seed=5)
    assert settings == SC.random_settings({"maxDepth": [1, 4], "subsamplingRate": (0.5, 1.0)}, 4, seed=5)
    assert all(0.5 <= s["subsamplingRate"] <= 1 for s in settings)
    make = lambda trees, setting: SC.estimators(trees=trees)["forest"]().setParams(**setting)
    data = SC.vectorised(table, ["x", "z"])
    best, fits = SC.tune_by_halving(data, make, settings, (2, 4), keep=2)
    assert [(b, sum(1 for f in fits if f[0] == b)) for b in (2, 4)] == [(2, 4), (4, 2)]
    last = [f for f in fits if f[0] == 4]
    assert settings[max(last, key=lambda f: (f[2], -f[1]))[1]] == best
    assert SC.tune_by_halving(data, make, settings, (2, 4), keep=2) == (best, fits)


def test_learned_dampen_reads_its_table_once(spark):
    """The table is made once and written, not once per pass of the fit."""
    seen = spark.sparkContext.accumulator(0)

    def noted(i):
        seen.add(1)
        return float(i % 7)

    made = F.udf(noted, "double").asNondeterministic()
    df = spark.range(200).select(F.col("id").alias("account_id"), F.lit(1).alias("is_mule"), ((F.col("id") % 10) / 10).alias("oof"), made("id").alias("x"))
    out = SC.learned_dampen(df, ["x"], "oof", 0.5, SC.estimators(trees=3)["forest"])
    assert out.count() == 200 and seen.value == 200
