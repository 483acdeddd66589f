"""Operators over an account's ordered transactions: pairs, gaps, trigrams, tail sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators.ranking import ordinal_rank, top_k
from ledgersignal.operators.skew import next_match, with_neighbours

A = "account_id"
ORDER = ("ts", "txn_id")


def dwell_pairs(txn: DataFrame, min_amount: float = S.LARGE_AMOUNT, **hot) -> DataFrame:
    """Large credits directly followed by a large debit, with the hours in between."""
    large = txn.filter(S.is_large_ge(F.abs("amount"), min_amount)).select(A, *ORDER, "txn_type")
    rows = with_neighbours(large, {"next_type": ("txn_type", -1), "next_ts": ("ts", -1)}, **hot)
    paired = (F.col("txn_type") == "C") & (F.col("next_type") == "D")
    hours = (S.micros("next_ts") - S.micros("ts")) / 3.6e9
    return rows.filter(paired).select(A, "txn_id", F.col("ts").alias("credit_ts"), F.col("next_ts").alias("debit_ts"), hours.alias("dwell_hours"))


def dwell_state_pairs(txn: DataFrame, min_amount: float = S.LARGE_AMOUNT, **hot) -> DataFrame:
    """The pending-credit form: a large debit takes the last unmatched large credit.

    A credit is pending exactly when the previous large credit-or-debit row is a credit, so rows of
    any other type are removed before looking back.
    """
    large = txn.filter(S.is_large_ge(F.abs("amount"), min_amount) & F.col("txn_type").isin("C", "D")).select(A, *ORDER, "txn_type")
    rows = with_neighbours(large, {"prev_type": ("txn_type", 1), "prev_ts": ("ts", 1)}, **hot)
    paired = (F.col("txn_type") == "D") & (F.col("prev_type") == "C")
    hours = (S.micros("ts") - S.micros("prev_ts")) / 3.6e9
    return rows.filter(paired).select(A, "txn_id", F.col("prev_ts").alias("credit_ts"), F.col("ts").alias("debit_ts"), hours.alias("dwell_hours"))


def passthrough_pairs(txn: DataFrame, hours: float = 48, tol: float = 0.05, **hot) -> DataFrame:
    """Each credit with the first later debit inside ``hours``; ``amount_match`` within ``tol``.

    One ordered pass instead of an interval join, so no credit-debit candidate pairs are made.
    """
    rows = txn.select(A, *ORDER, "txn_type", S.cents(F.abs("amount")).alias("cents"))
    debit = F.struct("ts", "txn_id", "cents")
    found = next_match(rows, F.col("txn_type") == "D", debit, "debit", **hot).filter(F.col("txn_type") == "C")
    elapsed = (S.micros("debit.ts") - S.micros("ts")) / 3.6e9
    close = F.abs(F.col("debit.cents") - F.col("cents")) <= tol * F.col("cents")
    return found.select(A, "txn_id", elapsed.alias("passthrough_hours"), close.cast("int").alias("amount_match")).filter(F.col("passthrough_hours") <= hours)


def gaps(txn: DataFrame, **hot) -> DataFrame:
    """Hours since the account's previous transaction (no row for the first one)."""
    rows = with_neighbours(txn.select(A, *ORDER), {"prev_ts": ("ts", 1)}, **hot)
    return rows.filter(F.col("prev_ts").isNotNull()).select(A, "txn_id", ((S.micros("ts") - S.micros("prev_ts")) / 3.6e9).alias("gap_h"))


def gap_stats(gap_rows: DataFrame, min_gaps: int = 3) -> DataFrame:
    """Mean, sample std, count and variation of gaps; missing with fewer than three gaps."""
    stats = gap_rows.groupBy(A).agg(F.avg("gap_h").alias("m"), F.stddev_samp("gap_h").alias("s"), F.count(F.lit(1)).alias("gap_count"))
    enough = F.col("gap_count") >= min_gaps
    return stats.select(
        A,
        F.when(enough, F.col("m")).alias("gap_mean"),
        F.when(enough, F.col("s")).alias("gap_std"),
        "gap_count",
        F.when(enough, S.safe_ratio("s", "m", 0.01)).alias("gap_cv"),
    )


def gap_frequency(stats: DataFrame) -> DataFrame:
    """The second variation of gap features: floor of one hour and a high-frequency flag."""
    return stats.select(
        A,
        S.safe_ratio("gap_std", "gap_mean", 1).alias("gap_cv_v10"),
        F.col("gap_mean").alias("gap_mean_hours"),
        F.coalesce((F.col("gap_mean") < 2).cast("int"), F.lit(0)).alias("high_freq_flag"),
    )


def trigrams(txn: DataFrame, **hot) -> DataFrame:
    """Three consecutive action codes per row, from the full account sequence."""
    actions = txn.select(A, *ORDER, S.action_code().alias("a0"))
    rows = with_neighbours(actions, {"a1": ("a0", -1), "a2": ("a0", -2)}, **hot)
    return rows.filter(F.col("a2").isNotNull()).select(A, F.concat_ws("|", "a0", "a1", "a2").alias("trigram"))


def trigram_counts(trigram_rows: DataFrame) -> DataFrame:
    return trigram_rows.groupBy(A, "trigram").agg(F.count(F.lit(1)).alias("n"))


def trigram_enrichment(counts: DataFrame, labels: DataFrame, min_mule: int = 5, k: int = 10) -> DataFrame:
    """The k trigrams that are most over-represented among labelled mules."""
    labelled = counts.join(labels.select(A, "is_mule"), A)
    mule, legit = F.col("is_mule") == 1, F.col("is_mule") == 0
    per = labelled.groupBy("trigram").agg(
        F.coalesce(F.sum(F.when(mule, F.col("n"))), F.lit(0)).alias("mule_count"), F.coalesce(F.sum(F.when(legit, F.col("n"))), F.lit(0)).alias("legit_count")
    )
    totals = per.agg(F.struct(F.sum("mule_count").alias("m"), F.sum("legit_count").alias("l")).alias("t")).scalar()
    scored = per.withColumn("_t", totals)
    ratio = (F.col("mule_count") / F.col("_t.m")) / F.greatest(F.col("legit_count") / F.col("_t.l"), F.lit(1e-8))
    enriched = scored.filter(F.col("mule_count") >= min_mule).withColumn("enrichment", ratio).drop("_t")
    return top_k(enriched, [F.col("enrichment").desc(), F.col("trigram")], k)


def trigram_features(counts: DataFrame, top: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct share of trigrams and how many belong to the mule list (0 without trigrams)."""
    marked = counts.join(top.select("trigram", F.lit(1).alias("_hit")), "trigram", "left")
    stats = marked.groupBy(A).agg(
        (F.count(F.lit(1)) / F.sum("n")).alias("trigram_diversity"), F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("n"))), F.lit(0)).alias("mule_trigram_count")
    )
    return accounts.select(A).join(stats, A, "left").fillna(0)


def build_vocab(txn: DataFrame, column: str) -> DataFrame:
    """Category to index in value order; 0 is padding and 1 is unknown."""
    values = txn.filter(F.col(column).isNotNull()).select(column).distinct()
    return ordinal_rank(values, [column], "_r").select(column, (F.col("_r") + 1).alias("idx"))


def encode(df: DataFrame, column: str, vocab: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
    """Indexes by a vocabulary, which is broadcast if it has at most ``most`` counted entries."""
    table = vocab.withColumnRenamed("idx", name)
    table = F.broadcast(table) if table.limit(most + 1).count() <= most else table
    return df.join(table, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def tail_rows(txn: DataFrame, n: int = 200, mcc_vocab: DataFrame | None = None, channel_vocab: DataFrame | None = None) -> DataFrame:
    """The latest n transactions of each account with model inputs and a position (1 = oldest kept).

    Time deltas are those of the whole ledger: one row more than wanted is kept for the oldest delta. The
    row limit is applied inside every map task first (window group limit), so a task sends at most n + 1
    rows of an account and a hot account never travels whole.
    """
    latest = Window.partitionBy(A).orderBy(*[F.col(c).desc() for c in ORDER])
    columns = txn.select(
        A, *ORDER, "mcc_code", "channel", S.log_amount("amount").alias("log_amt"), F.when(F.col("txn_type") == "C", 1).otherwise(-1).alias("dir")
    )
    rows = columns.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n + 1)
    delta = (S.micros("ts") - S.micros(F.lead("ts").over(latest))) / 3.6e9
    kept = rows.withColumn("time_delta", F.coalesce(delta, F.lit(0.0))).filter(F.col("_rn") <= n)
    for column, vocab, name in (("mcc_code", mcc_vocab, "mcc_idx"), ("channel", channel_vocab, "chan_idx")):
        kept = encode(kept, column, vocab, name) if vocab is not None else kept.withColumn(name, F.lit(1).cast("bigint"))
    length = F.count(F.lit(1)).over(Window.partitionBy(A))
    return kept.withColumn("length", length).withColumn("position", F.col("length") - F.col("_rn") + 1).drop("_rn", "mcc_code", "channel")


def tail_sequence(tail: DataFrame, n: int = 200) -> DataFrame:
    """One array per account, padded with zeros in front to exactly n steps (at most n rows each)."""
    step = F.struct("position", "log_amt", F.col("dir").cast("double").alias("dir"), "time_delta", F.col("mcc_idx").cast("bigint").alias("mcc_idx"), F.col("chan_idx").cast("bigint").alias("chan_idx"))
    grouped = tail.groupBy(A).agg(F.max("length").alias("length"), F.array_sort(F.collect_list(step)).alias("_steps"))
    features = F.transform("_steps", lambda s: s.dropFields("position"))
    blank = F.struct(F.lit(0.0).alias("log_amt"), F.lit(0.0).alias("dir"), F.lit(0.0).alias("time_delta"), F.lit(0).cast("bigint").alias("mcc_idx"), F.lit(0).cast("bigint").alias("chan_idx"))
    padding = F.array_repeat(blank, (F.lit(n) - F.col("length")).cast("int"))
    return grouped.select(A, "length", F.concat(padding, features).alias("steps"))


def attach_side_ledger(txn: DataFrame, side: DataFrame, keys: Sequence[str] = ("transaction_id",), how: str = "inner") -> DataFrame:
    """Equi-join of the two ledgers; add ``batch`` to the keys when both carry it."""
    return txn.join(side, list(keys), how)
