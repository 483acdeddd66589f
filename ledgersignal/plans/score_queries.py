"""Queries over evaluation, reports and model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import evaluate as EV
from ledgersignal.operators import reports as RE
from ledgersignal.operators import scoring as SC
from ledgersignal.operators import windows as WI
from ledgersignal.operators import encode as EN
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.bank_features import numeric_features, score_and_locate
from ledgersignal.plans.feature_table import signal_table, stored_features
from ledgersignal.plans.ledger_queries import DAILY_L
from ledgersignal.plans.registry import query
from ledgersignal.plans.window_queries import cdf, qday, totals
from ledgersignal.session import cut_lineage
from ledgersignal.sources import adapters as AD

A = "account_id"
W = O.with_
GRID = EV.grid_points(0.10, 0.95, 0.005)
GRID_SQL = f"grid AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS threshold)"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
F2 = "CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END"
SWEEP = f"""sweep AS (SELECT *, {F1} AS f1, {F2} AS f2 FROM (SELECT threshold, count(*) FILTER (score > threshold AND is_mule = 1) AS tp, count(*) FILTER (score > threshold AND is_mule = 0) AS fp,
  count(*) FILTER (score <= threshold AND is_mule = 1) AS fn, count(*) FILTER (score <= threshold AND is_mule = 0) AS tn FROM scores, grid GROUP BY threshold))"""
SWEEP_COLUMNS = dict(i="tp fp fn tn", d="threshold f1 f2")


@query("auc", i="n_pos n_neg", d="auc", sql=W("""SELECT sum(CASE WHEN is_mule = 1 THEN r ELSE 0 END) AS rs, count(*) FILTER (is_mule = 1) AS n_pos, count(*) FILTER (is_mule = 0) AS n_neg,
  (sum(CASE WHEN is_mule = 1 THEN r ELSE 0 END) - count(*) FILTER (is_mule = 1) * (count(*) FILTER (is_mule = 1) + 1) / 2) / (count(*) FILTER (is_mule = 1) * count(*) FILTER (is_mule = 0)) AS auc
  FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scores)""", O.SCORES))
def _(spark, sf):
    return EV.auc(AD.scores(spark, sf))


@query("pr_curve", i="tp fp", d="threshold precision recall", sql=W("""SELECT DISTINCT score AS threshold, count(*) FILTER (is_mule = 1) OVER o AS tp, count(*) FILTER (is_mule = 0) OVER o AS fp,
  count(*) FILTER (is_mule = 1) OVER o / count(*) OVER o AS precision, count(*) FILTER (is_mule = 1) OVER o / (SELECT sum(is_mule) FROM scores) AS recall FROM scores WINDOW o AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING)""", O.SCORES))
def _(spark, sf):
    return EV.pr_curve(AD.scores(spark, sf))


@query("threshold_table", **SWEEP_COLUMNS, sql=W("SELECT * FROM sweep", O.SCORES, GRID_SQL, SWEEP))
def _(spark, sf):
    return EV.threshold_table(AD.scores(spark, sf), GRID)


def _sweep(name, w1, w2):
    @query(name, **SWEEP_COLUMNS, sql=W(f"SELECT * FROM sweep ORDER BY round({w1} * f1 + {w2} * f2, 12) DESC, threshold LIMIT 1", O.SCORES, GRID_SQL, SWEEP))
    def _(spark, sf):
        return EV.threshold_sweep(AD.scores(spark, sf), GRID, (w1, w2))


_sweep("threshold_sweep", 1.0, 0.0)
_sweep("threshold_sweep_f2", 0.0, 1.0)
_sweep("threshold_sweep_balanced", 0.6, 0.4)


@query("confusion", i="tn fp fn tp", d="accuracy precision recall f1 f2", sql=W(f"SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, {F1} AS f1, {F2} AS f2 FROM (SELECT count(*) FILTER (score > 0.5 AND is_mule = 1) AS tp, count(*) FILTER (score > 0.5 AND is_mule = 0) AS fp, count(*) FILTER (score <= 0.5 AND is_mule = 1) AS fn, count(*) FILTER (score <= 0.5 AND is_mule = 0) AS tn FROM scores)", O.SCORES))
def _(spark, sf):
    return EV.confusion(AD.scores(spark, sf), 0.5)


@query("prob_errors", d="mae mse rmse rmsle smape", sql=W("""SELECT avg(abs(score - is_mule)) AS mae, avg(pow(score - is_mule, 2)) AS mse, sqrt(avg(pow(score - is_mule, 2))) AS rmse,
  sqrt(avg(pow(ln(1 + least(greatest(score, 1e-8), 1)) - ln(1 + least(greatest(is_mule, 1e-8), 1)), 2))) AS rmsle, 100 * avg(2 * abs(score - is_mule) / (abs(score) + abs(is_mule) + 1e-8)) AS smape FROM scores""", O.SCORES))
def _(spark, sf):
    return EV.prob_errors(AD.scores(spark, sf))


@query("calibration_check", i="n_rows expected above_30 above_50 above_80", d="mean_score base_rate", sql=W("SELECT count(*) AS n_rows, sum(is_mule) AS expected, avg(score) AS mean_score, avg(is_mule) AS base_rate, count(*) FILTER (score > 0.3) AS above_30, count(*) FILTER (score > 0.5) AS above_50, count(*) FILTER (score > 0.8) AS above_80 FROM scores", O.SCORES))
def _(spark, sf):
    return EV.calibration_check(AD.scores(spark, sf))


# ---- reports -------------------------------------------------------------------------------

WINDOWS = f"win AS (SELECT account_id, {qday(10)} AS start_day, {qday(90)} AS end_day FROM cum_t GROUP BY account_id)"
SUBMISSION = ", ".join([O.LABELS, O.SCORES, DAILY_L, totals(3, source="(SELECT daily.* FROM daily JOIN scores USING (account_id) WHERE score > 0.32)"), cdf("base"), WINDOWS, """sub AS (
  SELECT labels_t.account_id, score, coalesce(strftime(DATE '1970-01-01' + CAST(start_day AS INT), '%Y-%m-%dT00:00:00'), '') AS suspicious_start, coalesce(strftime(DATE '1970-01-01' + CAST(end_day AS INT), '%Y-%m-%dT23:59:59'), '') AS suspicious_end
  FROM labels_t LEFT JOIN scores USING (account_id) LEFT JOIN win ON labels_t.account_id = win.account_id WHERE is_test)"""])


def submission(spark, sf):
    scores = AD.scores(spark, sf)
    windows = WI.window_cdf(AC.daily_series(AD.lineitem_ledger(spark, sf), WI.gate(scores, 0.8, 0.4)))
    return RE.assemble_submission(AD.labels(spark, sf).filter("is_test"), scores, windows)


@query("assemble_submission", i="account_id", d="score", s="suspicious_start suspicious_end", sql=W("SELECT * FROM sub", SUBMISSION))
def _(spark, sf):
    return submission(spark, sf)


@query("score_overview", i="n_rows above_30 above_50 above_80 with_window", d="mean_score", sql=W("SELECT count(*) AS n_rows, avg(score) AS mean_score, count(*) FILTER (score > 0.3) AS above_30, count(*) FILTER (score > 0.5) AS above_50, count(*) FILTER (score > 0.8) AS above_80, count(*) FILTER (suspicious_start <> '') AS with_window FROM sub", SUBMISSION))
def _(spark, sf):
    return EV.score_overview(submission(spark, sf))


@query("overview", i="n_accounts n_flagged", d="pct_flagged", sql=W("SELECT count(*) AS n_accounts, count(*) FILTER (score > 0.5) AS n_flagged, 100 * count(*) FILTER (score > 0.5) / count(*) AS pct_flagged FROM scores", O.SCORES))
def _(spark, sf):
    return RE.overview(AD.scores(spark, sf))


@query("high_risk", i="account_id", d="score", sql=W("SELECT account_id, score FROM scores WHERE score > 0.8", O.SCORES))
def _(spark, sf):
    return RE.high_risk(AD.scores(spark, sf))


@query("score_histogram", i="bin n_rows", d="lower upper", sql=W("""SELECT bin, coalesce(n_rows, 0) AS n_rows, lo + bin * w AS lower, lo + (bin + 1) * w AS upper FROM (SELECT unnest(range(20)) AS bin) LEFT JOIN
  (SELECT least(floor((score - lo) / w), 19) AS bin, count(*) AS n_rows FROM scores, lim GROUP BY 1) USING (bin), lim""", O.SCORES, "lim AS (SELECT min(score) AS lo, (max(score) - min(score)) / 20 AS w FROM scores)"))
def _(spark, sf):
    return RE.score_histogram(AD.scores(spark, sf))


@query("lookup", i="account_id", d="score", s="suspicious_start suspicious_end", sql=W("SELECT * FROM sub WHERE account_id = 5", SUBMISSION))
def _(spark, sf):
    return RE.lookup(submission(spark, sf), 5)


# ---- score arithmetic ----------------------------------------------------------------------

def three_scores(spark, sf):
    extra = [(AD.hash_bucket(A, s, 1000) / 1000 * 0.7 + F.col("is_mule") * 0.2).alias(s) for s in ("m2", "m3")]
    return AD.scores(spark, sf).select(A, "is_mule", F.col("score").alias("m1"), *extra)


THREE = f"three AS (SELECT account_id, is_mule, score AS m1, ({O.bucket('account_id', 'm2', 1000)}) / 1000 * 0.7 + is_mule * 0.2 AS m2, ({O.bucket('account_id', 'm3', 1000)}) / 1000 * 0.7 + is_mule * 0.2 AS m3 FROM scores)"


@query("blend", i="account_id", d="blend", sql=W("SELECT account_id, 0.4 * m1 + 0.3 * m2 + 0.3 * m3 AS blend FROM three", O.SCORES, THREE))
def _(spark, sf):
    return SC.blend(three_scores(spark, sf), {"m1": 0.4, "m2": 0.3, "m3": 0.3})


def _auc_sql(c):
    return f"(SELECT (sum(CASE WHEN is_mule = 1 THEN r ELSE 0 END) - count(*) FILTER (is_mule = 1) * (count(*) FILTER (is_mule = 1) + 1) / 2) / (count(*) FILTER (is_mule = 1) * count(*) FILTER (is_mule = 0)) FROM (SELECT is_mule, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r FROM three))"


@query("auc_weighted_blend", i="account_id", d="blend", sql=W("""SELECT account_id, (m1 * r1 + m2 * r2 + m3 * r3) / (r1 + r2 + r3) AS blend FROM three,
  (SELECT (a1 - lo) / (hi - lo + 1e-9) + 0.5 AS r1, (a2 - lo) / (hi - lo + 1e-9) + 0.5 AS r2, (a3 - lo) / (hi - lo + 1e-9) + 0.5 AS r3 FROM (SELECT *, least(a1, a2, a3) AS lo, greatest(a1, a2, a3) AS hi FROM aucs))""",
    O.SCORES, THREE, f"aucs AS (SELECT {_auc_sql('m1')} AS a1, {_auc_sql('m2')} AS a2, {_auc_sql('m3')} AS a3)"))
def _(spark, sf):
    return SC.auc_weighted_blend(three_scores(spark, sf), ["m1", "m2", "m3"])


@query("rank_average", i="account_id", d="rank_average", sql=W("SELECT account_id, m / max(m) OVER () AS rank_average FROM (SELECT account_id, (" + " + ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2" for c in ("m1", "m2", "m3")) + ") / 3 AS m FROM three)", O.SCORES, THREE))
def _(spark, sf):
    return SC.rank_average(three_scores(spark, sf), ["m1", "m2", "m3"])


@query("rule_dampen", i="account_id", d="dampened", sql=W("SELECT account_id, CASE WHEN score > 0.3 AND k < 2 THEN score * 0.6 WHEN score > 0.3 AND k < 3 THEN score * 0.8 ELSE score END AS dampened FROM (SELECT *, " + O.bucket("account_id", "sig", 6) + " AS k FROM scores)", O.SCORES))
def _(spark, sf):
    return AD.scores(spark, sf).select(A, RE.rule_dampen(F.col("score"), AD.hash_bucket(A, "sig", 6)).alias("dampened"))


@query("screen_red_herrings", i="account_id", d="m1", sql=W("SELECT account_id, m1 FROM three WHERE NOT (is_mule = 1 AND (m1 < 0.45 OR (m1 < 0.6 AND " + O.bucket("account_id", "sig", 6) + " < 2)))", O.SCORES, THREE))
def _(spark, sf):
    return SC.screen_red_herrings(three_scores(spark, sf).withColumn("k", AD.hash_bucket(A, "sig", 6)), "m1", low=0.45, moderate=0.6, n_signals="k")


@query("soft_weights", i="account_id", d="sample_weight", sql=W("SELECT account_id, CASE WHEN (is_mule = 1 AND m1 >= 0.02 AND m1 < 0.1) OR (is_mule = 0 AND m1 > 0.8) THEN 0.3 ELSE 1 END AS sample_weight FROM three", O.SCORES, THREE))
def _(spark, sf):
    return SC.soft_weights(three_scores(spark, sf), "v2", "m1")


ERRORS = ("m2", "m3")


@query("error_profile", i="n_rows", d="m2 m3", s="outcome", sql=W("SELECT * FROM (SELECT CASE WHEN m1 > 0.5 AND is_mule = 1 THEN 'TP' WHEN m1 > 0.5 THEN 'FP' WHEN is_mule = 1 THEN 'FN' END AS outcome, count(*) AS n_rows, avg(m2) AS m2, avg(m3) AS m3 FROM three GROUP BY 1) WHERE outcome IS NOT NULL", O.SCORES, THREE))
def _(spark, sf):
    return SC.error_profile(three_scores(spark, sf), ERRORS, 0.5, "m1")


@query("learned_dampen_steps", i="account_id", d="dampened", sql=W("SELECT account_id, CASE WHEN m1 > 0.15 AND m2 < 0.3 THEN m1 * 0.4 WHEN m1 > 0.15 AND m2 < 0.5 THEN m1 * 0.7 ELSE m1 END AS dampened FROM three", O.SCORES, THREE))
def _(spark, sf):
    return three_scores(spark, sf).select(A, SC.dampen_steps(F.col("m1"), F.col("m2"), 0.15, SC.DAMPEN_V9).alias("dampened"))


# ---- Spark ML: no SQL twin -----------------------------------------------------------------

FOLDS = 5


def model_table(spark, sf):
    """All feature groups with folds; models use every numeric feature column."""
    return EN.stratified_folds(stored_features(spark, sf), FOLDS, 7)


def _oof(name, kind):
    @query(name, i="account_id", d="oof")
    def _(spark, sf):
        table = model_table(spark, sf)
        return SC.oof_scores(SC.vectorised(table, numeric_features(table)), SC.estimators()[kind], FOLDS)[0]


_oof("oof_gbt", "gbt")
_oof("oof_forest", "forest")
_oof("oof_linear", "linear")


@query("red_herring_columns", s="feature", sql="SELECT 'leak' AS feature")
def _(spark, sf):
    table = stored_features(spark, sf).withColumn("leak", F.col("is_mule") * 1.0)
    found = SC.red_herring_columns(table, numeric_features(table))
    return spark.createDataFrame([(f,) for f in found], "feature string")


@query("stacked_scores", i="account_id", d="stacked")
def _(spark, sf):
    return SC.stack(EN.stratified_folds(three_scores(spark, sf), FOLDS), ["m1", "m2", "m3"], FOLDS)


# Least means of all runs that begin at or below a score, greatest of them: the min-max form of the monotone fit.
@query("calibrated_scores", i="account_id", d="calibrated", sql=W("""
  SELECT account_id, rate AS calibrated FROM scores JOIN points USING (score) JOIN (SELECT i, max(least_mean) AS rate FROM run_means GROUP BY i) USING (i)""",
    O.SCORES, "points AS (SELECT score, n, pos, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS cn, sum(pos) OVER (ORDER BY score) AS cp FROM (SELECT score, count(*) AS n, sum(is_mule) AS pos FROM scores GROUP BY score))",
    "run_means AS (SELECT b.i, min((b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least_mean FROM points a JOIN points b ON a.i <= b.i)"))
def _(spark, sf):
    return SC.calibrate_isotonic(three_scores(spark, sf), "m1")


@query("chosen_scores", i="account_id", d="score", s="choice")
def _(spark, sf):
    """The best of the mean, its out-of-fold calibration, the stacked score and the mean rank."""
    names = ["m1", "m2", "m3"]
    table = cut_lineage(SC.blend(EN.stratified_folds(three_scores(spark, sf), FOLDS), dict.fromkeys(names, 1 / 3), "mean"))
    joined = SC.calibrate_oof(table, "mean", FOLDS).join(SC.stack(table, names, FOLDS), A).join(SC.rank_average(table, names), A)
    return SC.choose_by_auc(cut_lineage(joined), ["mean", "calibrated", "stacked", "rank_average"])


@query("two_stage_funnel", i="account_id is_mule", d="funnel_score")
def _(spark, sf):
    table = model_table(spark, sf).join(AD.scores(spark, sf).select(A, "score"), A)
    return SC.two_stage_funnel(table, "score", [c for c in numeric_features(table) if c != "score"], SC.estimators()["forest"], 0.15, FOLDS)


@query("learned_dampen", i="account_id", d="dampened")
def _(spark, sf):
    table = signal_table(spark, sf).join(three_scores(spark, sf).select(A, "m1", F.col("m1").alias("oof")), A)
    names = [c for c in numeric_features(table) if c not in ("m1", "oof")]
    return SC.learned_dampen(table, names, "m1", 0.5, SC.estimators()["forest"])


@query("feature_importance", d="importance", s="feature")
def _(spark, sf):
    table = model_table(spark, sf)
    names = numeric_features(table)
    return SC.feature_importance(SC.pipeline(SC.estimators()["forest"]()).fit(SC.vectorised(table, names)), names, spark)


@query("retrain_if_better", i="account_id", d="score")
def _(spark, sf):
    table = model_table(spark, sf)
    base = ["txn_count", "total_volume", "amt_std", "credit_volume", "debit_volume", "near_threshold_pct"]
    return SC.retrain_if_better(table, base, [c for c in numeric_features(table) if c not in base], SC.estimators()["forest"], FOLDS)[0]


@query("tuned_scores", i="account_id", d="score")
def _(spark, sf):
    table = model_table(spark, sf)
    data = cut_lineage(SC.vectorised(table, numeric_features(table)))
    model = SC.tune(data, SC.estimators()["forest"](), {"maxDepth": [3, 5, 8], "numTrees": [20, 40]})
    return SC.probability(model.transform(data), "score")


@query("halving_scores", i="account_id", d="score")
def _(spark, sf):
    """Nine random forests by successive halving over growing numbers of trees; the winner scores all rows."""
    table = model_table(spark, sf)
    data = cut_lineage(SC.vectorised(table, numeric_features(table)))
    settings = SC.random_settings({"maxDepth": (3, 8), "minInstancesPerNode": [1, 5, 20], "subsamplingRate": (0.5, 1.0)}, 9)
    make = lambda trees, setting: SC.estimators(trees=trees)["forest"]().setParams(**setting)
    best, _ = SC.tune_by_halving(data, make, settings, (5, 15, 40))
    return SC.probability(SC.pipeline(make(40, best)).fit(data).transform(data), "score")


@query("seed_average", i="account_id", d="score")
def _(spark, sf):
    table = model_table(spark, sf)
    return SC.seed_average(SC.vectorised(table, numeric_features(table)), [SC.estimators(seed=s)["forest"] for s in (42, 99, 123)], FOLDS)


@query("score_and_locate", i="account_id", d="score", s="suspicious_start suspicious_end")
def _(spark, sf):
    table = model_table(spark, sf).withColumn("is_mule", F.when(~F.col("is_test"), F.col("is_mule")))
    return score_and_locate(table, AD.lineitem_ledger(spark, sf), SC.estimators()["forest"], numeric_features(table), FOLDS, scales=(365, 720, 1440))
