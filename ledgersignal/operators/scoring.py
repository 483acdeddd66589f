"""Scoring with Spark ML estimators: out-of-fold scores, screening, blending, calibration."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.functions.scalars import total_of
from ledgersignal.operators import evaluate
from ledgersignal.operators.isotonic import apply_isotonic, fit_isotonic
from ledgersignal.operators.ranking import rank_columns
from ledgersignal.session import cut_lineage

A = "account_id"


def estimators(seed: int = 42, trees: int = 40, depth: int = 5) -> dict[str, Callable[[], Estimator]]:
    """Factories of the model family: boosted trees, a forest and a regularised linear model."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "gbt": lambda: GBTClassifier(**common, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed),
        "forest": lambda: RandomForestClassifier(**common, numTrees=trees, maxDepth=depth + 3, seed=seed),
        "linear": lambda: LogisticRegression(**{**common, "featuresCol": "scaled"}, regParam=0.01, maxIter=100),
    }


def vectorised(df: DataFrame, features: Sequence[str], y: str = "is_mule") -> DataFrame:
    """(account, label, weight, features): missing features are 0, classes weighted to balance."""
    filled = df.fillna(0, subset=list(features))
    counts = df.agg(F.sum(1 - F.col(y)) / F.greatest(F.sum(y), F.lit(1)))
    base = filled.withColumn("_ratio", counts.scalar())
    balance = F.when(F.col(y) == 1, F.col("_ratio")).otherwise(F.lit(1.0))
    given = F.col("sample_weight") if "sample_weight" in df.columns else F.lit(1.0)
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(base)
    extra = [c for c in ("fold",) if c in df.columns]
    return assembled.select(A, F.col(y).cast("double").alias("label"), (balance * given).alias("weight"), "features", *extra)


def pipeline(estimator: Estimator) -> Pipeline:
    stages: list = [estimator]
    if estimator.getFeaturesCol() == "scaled":
        stages.insert(0, StandardScaler(inputCol="features", outputCol="scaled"))
    return Pipeline(stages=stages)


def probability(scored: DataFrame, name: str) -> DataFrame:
    return scored.select(A, vector_to_array("probability")[1].alias(name))


def red_herring_columns(train: DataFrame, features: Sequence[str], limit: float = 0.90, y: str = "is_mule") -> list[str]:
    """Features that alone dominate a shallow tree, which marks a leak rather than a signal."""
    data = vectorised(train, features, y)
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=3, seed=42).fit(data)
    shares = tree.featureImportances.toArray()
    return [f for f, s in zip(features, shares, strict=True) if s > limit]


def oof_scores(data: DataFrame, make: Callable[[], Estimator], k: int, name: str = "oof", parallel: int = 3, test: DataFrame | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Score every row with the model of the other folds; test rows get the mean of all models.

    ``data`` and ``test`` are ``vectorised``. The vector table is written once, unless it is ``stored`` already; folds
    are independent jobs started from a few driver threads that hold no data.
    """
    data = data if stored else cut_lineage(data)

    def one(i: int) -> PipelineModel:
        return pipeline(make()).fit(data.filter(F.col("fold") != i))

    with ThreadPoolExecutor(parallel) as pool:
        models = list(pool.map(one, range(k)))
    scored = [probability(m.transform(data.filter(F.col("fold") == i)), name) for i, m in enumerate(models)]
    oof = scored[0]
    for piece in scored[1:]:
        oof = oof.unionByName(piece)
    held = None
    if test is not None:
        held = test
        for i, m in enumerate(models):
            p = m.transform(held).withColumn(f"_p{i}", vector_to_array("probability")[1])
            held = p.drop("probability", "rawPrediction", "prediction", "scaled")
        held = held.select(A, (total_of([F.col(f"_p{i}") for i in range(k)]) / k).alias(name))
    return cut_lineage(oof), held


def screen_red_herrings(df: DataFrame, oof: str = "oof", y: str = "is_mule", low: float = 0.02, moderate: float | None = None, n_signals: str | None = None) -> DataFrame:
    """Drop labelled positives that the screening model finds implausible."""
    pos = F.col(y) == 1
    drop = pos & (F.col(oof) < low)
    if moderate is not None and n_signals:
        drop = drop | (pos & (F.col(oof) < moderate) & (F.col(n_signals) < 2))
    return df.filter(~drop)


def soft_weights(df: DataFrame, variant: str = "v7", oof: str = "oof", y: str = "is_mule", n_signals: str = "multi_signal_count") -> DataFrame:
    """Lower training weight of ambiguous rows instead of dropping them."""
    p, pos = F.col(oof), F.col(y) == 1
    rules = {
        "v2": F.when((pos & (p >= 0.02) & (p < 0.10)) | (~pos & (p > 0.8)), 0.3),
        "v7": F.when(pos & (p >= 0.02) & (p < 0.15) & (F.col(n_signals) < 3), 0.5) if n_signals in df.columns else F.when(pos & (p >= 0.02) & (p < 0.15), 0.5),
        "v9": F.when(pos & (p >= 0.015) & (p < 0.15), 0.6),
    }
    return df.withColumn("sample_weight", rules[variant].otherwise(1.0))


def blend(df: DataFrame, weights: dict[str, float], name: str = "blend") -> DataFrame:
    return df.withColumn(name, total_of([F.col(c) * w for c, w in weights.items()]))


def auc_weights(aucs: dict[str, float]) -> dict[str, float]:
    """Weights from single-model AUCs: rescaled to [0.5, 1.5], then normalised."""
    lo, hi = min(aucs.values()), max(aucs.values())
    raw = {k: (v - lo) / (hi - lo + 1e-9) + 0.5 for k, v in aucs.items()}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def auc_weighted_blend(df: DataFrame, columns: Sequence[str], y: str = "is_mule", name: str = "blend") -> DataFrame:
    """Blend by out-of-fold AUC; the AUCs are one number per model."""
    aucs = {c: evaluate.auc(df, c, y).first()["auc"] for c in columns}
    return blend(df, auc_weights(aucs), name)


def better_blend(df: DataFrame, fixed: dict[str, float], y: str = "is_mule", name: str = "blend") -> DataFrame:
    """The fixed or the AUC-weighted blend, whichever has the higher AUC (fixed wins ties)."""
    both = auc_weighted_blend(blend(df, fixed, "_fixed"), list(fixed), y, "_auto")
    a, b = (evaluate.auc(both, c, y).first()["auc"] for c in ("_fixed", "_auto"))
    return both.withColumn(name, F.col("_auto") if b > a else F.col("_fixed")).drop("_fixed", "_auto")


def rank_average(df: DataFrame, columns: Sequence[str], name: str = "rank_average") -> DataFrame:
    """Mean of average-tie ranks divided by its maximum."""
    ranks = rank_columns(df, A, {c: F.col(c) for c in columns}, fill=None, pct=False)
    mean = ranks.select(A, (total_of([F.col(f"{c}_rank") for c in columns]) / len(columns)).alias("_mean"))
    top = mean.agg(F.max("_mean")).scalar()
    return mean.withColumn("_top", top).select(A, (F.col("_mean") / F.col("_top")).alias(name))


def stack(df: DataFrame, columns: Sequence[str], k: int, y: str = "is_mule", name: str = "stacked") -> DataFrame:
    """Logistic regression over out-of-fold scores, itself scored out of fold."""
    data = vectorised(df, columns, y).withColumn("weight", F.lit(1.0))
    make = lambda: LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100)
    scored, _ = oof_scores(data, make, k, name)
    return scored


def calibrate_isotonic(df: DataFrame, score: str, y: str = "is_mule", name: str = "calibrated") -> DataFrame:
    """Monotone score-to-rate mapping, fitted on and applied to the same rows."""
    return apply_isotonic(df, score, fit_isotonic(df, score, y), name)


def calibrate_oof(df: DataFrame, score: str, k: int, y: str = "is_mule", name: str = "calibrated") -> DataFrame:
    """Every fold is mapped by the fit of the other folds, so that a row's own label never enters its score."""
    parts = [apply_isotonic(df.filter(F.col("fold") == i), score, fit_isotonic(df.filter(F.col("fold") != i), score, y), name) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def best_by_auc(df: DataFrame, columns: Sequence[str], y: str = "is_mule") -> str:
    """Name of the candidate score with the highest exact AUC (first wins ties)."""
    aucs = {c: evaluate.auc(df, c, y).first()["auc"] for c in columns}
    return max(columns, key=aucs.__getitem__)


def choose_by_auc(df: DataFrame, columns: Sequence[str], y: str = "is_mule", name: str = "score") -> DataFrame:
    """(account, label, chosen score, name of the choice): the candidate with the highest AUC."""
    best = best_by_auc(df, columns, y)
    return df.select(A, y, F.col(best).alias(name), F.lit(best).alias("choice"))


def two_stage_funnel(df: DataFrame, stage1: str, features: Sequence[str], make: Callable[[], Estimator], gate: float = 0.15, k: int = 3, y: str = "is_mule") -> DataFrame:
    """A second model on the rows that pass the first score; the others score 0."""
    passed = vectorised(df.filter(F.col(stage1) > gate), features, y)
    second, _ = oof_scores(passed, make, k, "_p2")
    return df.select(A, y).join(second, A, "left").select(A, y, F.coalesce("_p2", F.lit(0.0)).alias("funnel_score"))


def dampen_steps(p: Column, p_real: Column, gate: float, steps: Sequence[tuple[float, float]]) -> Column:
    """Shrink scores above the gate when the plausibility is low: first step that applies wins."""
    chain = None
    for limit, factor in steps:
        hit = (p > gate) & (p_real < limit)
        chain = F.when(hit, p * factor) if chain is None else chain.when(hit, p * factor)
    return chain.otherwise(p)


# Fixed values: (plausibility limit, factor) steps of the two learned dampening rules.
DAMPEN_V9 = ((0.30, 0.4), (0.50, 0.7))
DAMPEN_V10 = ((0.25, 0.35), (0.45, 0.65))


def learned_dampen(df: DataFrame, features: Sequence[str], score: str, threshold: float, make: Callable[[], Estimator], screen: str = "oof", y: str = "is_mule", gate: float = 0.3, steps=DAMPEN_V9, min_class: int = 10) -> DataFrame:
    """Learn which labelled positives look genuine and dampen implausible high scores.

    Skipped when either class has too few rows. Both tables are written once, as each pass of the fit reads them.
    """
    df = cut_lineage(df)
    mules = df.filter(F.col(y) == 1).withColumn("_real", (F.col(screen) > 0.4).cast("int"))
    real, fake = mules.agg(F.coalesce(F.sum("_real"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_real")), F.lit(0))).first()
    if real <= min_class or fake <= min_class:
        return df.withColumn("dampened", F.col(score))
    model = pipeline(make()).fit(cut_lineage(vectorised(mules, features, "_real").withColumn("weight", F.lit(1.0))))
    plausible = probability(model.transform(vectorised(df.withColumn("_real", F.lit(0)), features, "_real")), "_p_real")
    joined = df.join(plausible, A)
    return joined.withColumn("dampened", dampen_steps(F.col(score), F.col("_p_real"), gate * threshold, steps)).drop("_p_real")


def error_profile(df: DataFrame, columns: Sequence[str], threshold: float, score: str = "score", y: str = "is_mule") -> DataFrame:
    """Mean of analysis columns for true positives, false positives and false negatives."""
    hit, pos = F.col(score) > threshold, F.col(y) == 1
    outcome = F.when(hit & pos, "TP").when(hit & ~pos, "FP").when(~hit & pos, "FN")
    return df.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in columns])


def retrain_if_better(df: DataFrame, base: Sequence[str], extra: Sequence[str], make: Callable[[], Estimator], k: int, y: str = "is_mule") -> tuple[DataFrame, bool]:
    """Keep the extra features only if they raise the out-of-fold AUC."""
    def run(features):
        scored, _ = oof_scores(vectorised(df, features, y), make, k, "score")
        joined = df.select(A, y).join(scored, A)
        return scored, evaluate.auc(joined, "score", y).first()["auc"]

    first, auc_first = run(list(base))
    second, auc_second = run([*base, *extra])
    return (second, True) if auc_second > auc_first else (first, False)


def feature_importance(model: PipelineModel, features: Sequence[str], spark, k: int = 20) -> DataFrame:
    """Split importances, largest first (one row per feature name)."""
    shares = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(s)) for f, s in zip(features, shares, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)


def tune(data: DataFrame, estimator: Estimator, grid: dict, parallel: int = 3, seed: int = 42):
    """Grid search on one hold-out split; returns the fitted TrainValidationSplit model."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    split = TrainValidationSplit(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, trainRatio=0.75, parallelism=parallel, seed=seed)
    return split.fit(data)


def random_settings(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded draws: one of a list, or a number of a (low, high) tuple, whole if both ends are."""
    draw = random.Random(seed)

    def one(choice):
        if not isinstance(choice, tuple):
            return draw.choice(list(choice))
        return draw.randint(*choice) if all(isinstance(c, int) for c in choice) else draw.uniform(*choice)

    return [{name: one(choice) for name, choice in space.items()} for _ in range(n)]


def tune_by_halving(data: DataFrame, make: Callable[[int, dict], Estimator], settings: Sequence[dict], budgets: Sequence[int], keep: int = 3, seed: int = 42, parallel: int = 3) -> tuple[dict, list[tuple[int, int, float]]]:
    """Successive halving: all settings with the smallest budget, the best one in ``keep`` with the next.

    ``make(budget, setting)`` gives an estimator. A hash of the account holds out a quarter of the rows, so reruns
    agree. Returns the winner and a (budget, setting number, held-out AUC) entry per fit; equal AUCs go by number.
    """
    split = cut_lineage(data.withColumn("_held", F.pmod(F.xxhash64(A, F.lit(seed)), F.lit(4)) == 0))
    train, held = split.filter(~F.col("_held")), split.filter("_held")
    alive, fits = list(range(len(settings))), []

    def held_auc(i: int, budget: int) -> float:
        model = pipeline(make(budget, settings[i])).fit(train)
        scored = model.transform(held).select("label", vector_to_array("probability")[1].alias("score"))
        return evaluate.auc(scored, "score", "label").first()["auc"]

    for budget in budgets:
        with ThreadPoolExecutor(parallel) as pool:
            aucs = list(pool.map(lambda i: held_auc(i, budget), alive))
        fits += [(budget, i, auc) for i, auc in zip(alive, aucs, strict=True)]
        order = sorted(zip(aucs, alive, strict=True), key=lambda pair: (-pair[0], pair[1]))
        alive = sorted(i for _, i in order[: max(1, len(order) // keep)])
        best = order[0][1]
    return settings[best], fits


def seed_average(data: DataFrame, makers: Sequence[Callable[[], Estimator]], k: int, name: str = "score") -> DataFrame:
    """Mean of the out-of-fold scores of several seeds or models; the vector table is written once for all."""
    data, total = cut_lineage(data), None
    for i, make in enumerate(makers):
        scored, _ = oof_scores(data, make, k, f"_s{i}", stored=True)
        total = scored if total is None else total.join(scored, A)
    return total.select(A, (total_of([F.col(f"_s{i}") for i in range(len(makers))]) / len(makers)).alias(name))
