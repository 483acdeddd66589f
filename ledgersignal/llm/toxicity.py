"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon terms, their nearness to second-person words, capitals, punctuation and
obfuscation rates. Besides a fixed lexicon one is learned: words and word beginnings that mark toxic rows
among labelled rows. Labelled training rows are divided by a hash into two halves, each of which is described
by the lexicon learned from the other, to fit the trees, and a part for the calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import small_batches
from ledgersignal.session import cut_lineage

#: Labelled rows used for fitting at most, taken by a hash of the id.
FIT_ROWS = 20_000
#: Learned lexicon: terms at most, toxic rows that hold a term at least, log odds at least.
LEARNED_TERMS, TERM_ROWS, TERM_ODDS = 3_000, 4, 2.5
TREES, DEPTH = 30, 4
REJECT = 0.7
NEAR_WORDS = 4

# Insults, and second-person words, in the languages at hand.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown garbage filth vermin "
    "imbecile fool bastard dumm blöd abschaum trottel versager wertlos idiota estúpido imbécil basura inútil escoria "
    "payaso stupide nul ordure minable crétin débile".split()
)
YOU = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te ti tus vous votre toi ton ta tes usted ustedes".split())
LEET = str.maketrans("013457$@!|", "oieastsail")
EDGES = ".,;:!?\"'()[]{}<>…«»“”„-*%#&$~`|/\\"
MARKS = re.compile(r"[!?]")
RUNS = re.compile(r"([^\w\s])\1+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
INSIDE = re.compile(r"[^\W\d_][\d$@!|*+][^\W\d_]|[^\W\d_][.\-_][^\W\d_][.\-_][^\W\d_]")

FEATURES = (
    "insult_density", "learned_density", "learned_top", "learned_sum", "hit_count", "near_you", "capital_rate", "shout_rate",
    "mark_rate", "run_rate", "obfuscated_rate", "deobfuscated_density", "log_words",
)


def terms_of(word: str) -> list[str]:
    """What the learned lexicon is looked up by: the word and its beginnings of four to seven letters."""
    return [word, *(word[:n] + "~" for n in range(4, min(8, len(word))))]


def features(text: str, learned: dict[str, float]) -> list[float]:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    insults = hits = shouts = odd = plain = 0
    top = total = 0.0
    hit_at, you_at = [], []
    get = learned.get
    for i, raw in enumerate(words):
        word = raw.strip(EDGES)
        low = word.lower()
        if low in YOU:
            you_at.append(i)
        weight = max([get(t, 0.0) for t in terms_of(low)])
        bad = low in INSULTS
        if not word.isalpha() and word and INSIDE.search(word):
            odd += 1
            clean = low.translate(LEET).replace(".", "").replace("-", "").replace("_", "").replace("*", "")
            plain += clean in INSULTS or clean in learned
        if bad or weight:
            insults += bad
            hits += 1
            total += weight
            top = max(top, weight)
            hit_at.append(i)
        shouts += len(word) > 1 and word.isupper()
    near = 0
    if hit_at and you_at:
        places = np.asarray(you_at)
        at = np.asarray(hit_at)
        k = np.searchsorted(places, at)
        left = np.abs(at - places[np.maximum(k - 1, 0)])
        right = np.abs(places[np.minimum(k, len(places) - 1)] - at)
        near = int((np.minimum(left, right) <= NEAR_WORDS).sum())
    return [
        insults / n, hits / n, top, total / math.sqrt(n), math.log1p(hits), near / n, len(UPPER.findall(text)) / chars, shouts / n,
        len(MARKS.findall(text)) / chars, len(RUNS.findall(text)) / n, odd / n, plain / n, math.log1p(len(words)),
    ]


def feature_column(text: Column, learned: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, learned) for t in texts])

    return dense(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of the terms that mark toxic rows; at most ``LEARNED_TERMS`` reach the driver."""

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for w in set(text.split()) for t in terms_of(w.strip(EDGES).lower())} - {""}) for text in texts])

    n = rows.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, clean = n["bad"] or 0, n["all"] - (n["bad"] or 0)
    if not bad or not clean:
        return {}
    spread = rows.select("toxic", F.explode(distinct_terms(F.coalesce("text", F.lit("")))).alias("term"))
    counted = spread.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    odds = F.ln((F.col("bad") + 0.5) / (bad + 1)) - F.ln((F.col("all") - F.col("bad") + 0.5) / (clean + 1))
    kept = counted.select("term", odds.alias("odds"), "bad").filter((F.col("odds") >= TERM_ODDS) & (F.col("bad") >= TERM_ROWS))
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc("bad"), "term").limit(LEARNED_TERMS).collect()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Callable[[DataFrame], DataFrame]:
    """Learn from labelled rows that are not held out; returns what adds ``score`` to rows with ``text``.

    Where the training rows lack one of the classes, the score is one of the fixed lexicon alone.
    """
    small_batches(docs)
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marks = marks.dropDuplicates(["doc_id"])
    share = min(1.0, fit_rows / max(1, marks.count()))
    unit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    marks = cut_lineage(marks.filter(unit < share))
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))  # at most about fit_rows rows
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(20))
    rows = rows.withColumn("part", part)
    halves = F.col("part") < 8, F.col("part").between(8, 15)
    learned = learned_lexicon(rows.filter("part < 16"))
    # Rows are described by a lexicon they have no part in: each half by that of the other half.
    described = [(halves[0], learned_lexicon(rows.filter(halves[1]))), (halves[1], learned_lexicon(rows.filter(halves[0]))), (F.col("part") > 15, learned)]
    tables = [rows.filter(own).select("toxic", "part", feature_column(F.col("text"), lexicon).alias("x")) for own, lexicon in described]
    table = cut_lineage(reduce(DataFrame.unionAll, tables).withColumn("x", array_to_vector("x")))
    classes = {r["toxic"]: r["n"] for r in table.groupBy("toxic").agg(F.count_if(F.col("part") < 16).alias("n")).collect()}
    if min(classes.get(c, 0) for c in (0, 1)) < 2:

        def by_lexicon(df: DataFrame) -> DataFrame:
            density = F.element_at(feature_column(F.col("text"), {}), 1)
            return df.withColumn("score", 1 - F.exp(-40 * density))

        return by_lexicon
    settings = {"labelCol": "toxic", "featuresCol": "x", "maxIter": TREES, "maxDepth": DEPTH, "stepSize": 0.2, "seed": 7, "checkpointInterval": -1}
    # Calibration needs rows the trees have not seen; with few rows of a class all of them serve for both.
    enough = table.filter((F.col("part") >= 16) & (F.col("toxic") == 1)).limit(20).count() == 20
    trees_rows = table.filter(F.col("part") < (16 if enough else 20))
    trees = GBTClassifier(**settings).fit(trees_rows.coalesce(4))

    def raw(df: DataFrame) -> DataFrame:
        scored = trees.transform(df).withColumn("_raw", F.round(vector_to_array("probability")[1], 3))
        return scored.drop("rawPrediction", "probability", "prediction")

    steps = raw(table.filter(F.col("part") >= (16 if enough else 0)))
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="w").fit(
        steps.groupBy("_raw").agg(F.avg("toxic").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))  # at most 1,001 points
    )
    bounds, values = [list(map(float, x.toArray())) for x in (curve.boundaries, curve.predictions)]

    @F.pandas_udf("double")
    def calibrated(p: pd.Series) -> pd.Series:
        # One hundredth of the raw probability keeps the order of scores within a level of the curve.
        return pd.Series(np.clip(0.99 * np.interp(p, bounds, values) + 0.01 * p, 0.0, 1.0))

    def score(df: DataFrame) -> DataFrame:
        dense = df.withColumn("x", array_to_vector(feature_column(F.col("text"), learned)))
        return trees.transform(dense).withColumn("score", calibrated(vector_to_array("probability")[1])).drop("x", "rawPrediction", "probability", "prediction")

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score in [0, 1], predicted.

    Scores come from the text alone, so equal texts score alike; null texts count as empty. Null ids are not
    held out. Labels without an id or a mark are not used; of several for an id one is. Other columns are not
    read. Fitting is bounded by ``FIT_ROWS``; every row is scored in one scan without a shuffle.
    """
    scored = fit(docs, labels)(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the rejection score, with all their columns.

    The texts are scored apart from the other columns, whose names may therefore be any.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    scored = fit(docs, labels)(packed)
    return scored.filter(F.col("score") < REJECT).select("row.*")
