"""The assembled account feature table: one row per account from any set of feature groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import derived as DE
from ledgersignal.operators import encode as EN
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators.skew import MIN_HOT_ROWS, HotAccounts, hot_accounts, most_rows, most_rows_bound
from ledgersignal.session import cut_lineage
from ledgersignal.sources import adapters as AD

A = "account_id"

# Groups read by the signals, and the order in which the full table joins its groups.
SIGNAL_GROUPS = ("core", "behaviour", "distinct", "dwell", "life", "balance", "geo", "residual", "flags", "encode")
ALL_GROUPS = ("core", "flow", "behaviour", "distinct", "gaps", "dwell", "life", "trigrams", "balance", "geo", "residual", "flags", "encode")


def assemble_features(universe: DataFrame, groups: Sequence[DataFrame], key: str = A) -> DataFrame:
    """Left-join feature groups, each unique by ``key``, to the universe of accounts.

    Every group is already aggregated by the join key, so the joins reuse that partitioning.
    """
    out = universe
    for g in groups:
        out = out.join(g, key, "left")
    return out


def encoded_labels(labels: DataFrame) -> DataFrame:
    """Branch rates: out-of-fold for training rows, all training rows for the others."""
    train = EN.stratified_folds(labels.filter(~F.col("is_test")), 5)
    test = labels.filter(F.col("is_test"))
    encoded = EN.target_encode_oof(train, test, "branch_code", "is_mule", "fold", name="branch_mule_rate_oof", full_name="branch_mule_rate")
    return encoded.select(A, "branch_mule_rate_oof", "branch_mule_rate")


ORDERED = {"gaps", "dwell", "trigrams"}
STORED_ROWS = 500_000  # Rows of a task over the stored feature table, at most about.
LAID_ROWS = 250_000  # Rows of a task over the laid ledger, about: it holds the sorts and hash tables of all groups.


def dealt_by_account(df: DataFrame, rows: int, key: str = A) -> DataFrame:
    """Rows dealt by account as those of a ledger of ``rows`` are, so that what they give needs no further shuffle to be joined."""
    spark = df.sparkSession
    if rows > LAID_ROWS * spark.sparkContext.defaultParallelism:
        return df.repartition(max(-(-rows // LAID_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
    return df.repartition(key)


def laid_ledger(txn: DataFrame, rows: int = 0) -> DataFrame:
    """The ledger laid out once by account and in order, for all groups that read it.

    ``txn_id`` becomes the position in the account's sequence, so rows stay narrow. Kept on the executors' disks;
    aggregates and windows by account over it need no further shuffle or sort. A ledger of many ``rows``, about, is
    dealt by their number, as partitions merged by their bytes would hold more than a task has memory for.
    """
    spark = txn.sparkSession
    if rows > LAID_ROWS * spark.sparkContext.defaultParallelism:
        txn = dealt_by_account(txn, rows)
    parts = [f"txn_id.{f.name}" for f in txn.schema["txn_id"].dataType.fields]  # in the same order, without the struct
    position = F.row_number().over(Window.partitionBy(A).orderBy("ts", *parts))
    return txn.filter(F.col(A).isNotNull()).withColumn("txn_id", position).sortWithinPartitions(A, *SQ.ORDER).persist(StorageLevel.DISK_ONLY)


def laid_orders(orders: DataFrame, rows: int) -> DataFrame:
    """The orders dealt once by account, for the accounts' dates and the side ledger; kept on the executors' disks."""
    read = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return dealt_by_account(orders.filter(F.col("o_custkey").isNotNull()).select(*read), rows, "o_custkey").persist(StorageLevel.DISK_ONLY)


def laid_mcc_counts(spark: SparkSession, sf_dir: str, laid: DataFrame, rows: int) -> DataFrame:
    """(account, ``mcc_nunique``, ``missing``: pairs of account and part without such a part) of a laid ledger with ``part_key``.

    Only the different pairs of account and part are sent to the parts, and only their codes are sent back; whole
    lines stay where they lie. Kept on the executors' disks.
    """
    pairs = laid.filter(F.col("part_key").isNotNull()).select(A, "part_key").distinct()
    coded = AD.mcc_of_parts(spark, sf_dir, pairs).select(A, "mcc_code", "part_known")
    missing = F.count_if(F.col("part_known").isNull()).alias("missing")
    return dealt_by_account(coded, rows).groupBy(A).agg(F.count_distinct("mcc_code").alias("mcc_nunique"), missing).persist(StorageLevel.DISK_ONLY)


def feature_groups(spark: SparkSession, sf_dir: str, wanted: Sequence[str], kept: list[DataFrame] | None = None) -> list[DataFrame]:
    """The wanted groups, each unique by account.

    With ``kept``, what several groups read is kept on disk and noted there, for the caller to release. A ledger
    with hot accounts is not laid out, as one of them would fill a task.
    """
    txn = AD.lineitem_ledger(spark, sf_dir)
    lines, orders = AD.table(spark, sf_dir, "lineitem"), AD.table(spark, sf_dir, "orders")
    labels = AD.labels(spark, sf_dir)

    hot, laid, rows, orders_each = None, None, 0, 0
    if ORDERED & set(wanted):
        # An account has at most the rows of its orders times those of the longest order: cheaper than to count them.
        # Mostly a bound on the longest order will do, which sends no row per order.
        orders_each = most_rows(orders, "o_custkey")
        few = any(max(most(lines, "l_orderkey"), 1) * orders_each <= MIN_HOT_ROWS for most in (most_rows_bound, most_rows))
        hot = HotAccounts(None) if few else hot_accounts(txn)
    if kept is not None and hot is not None and hot.table is None:
        rows = lines.count()
        deal = lambda joined: dealt_by_account(joined.filter(F.col(A).isNotNull()), rows)
        laid = laid_ledger(AD.lineitem_ledger(spark, sf_dir, part_key="distinct" in wanted, deal=deal))
        kept.append(laid)
        txn = laid.drop("part_key")
        if orders_each <= MIN_HOT_ROWS:
            orders = laid_orders(orders, rows)
            kept.append(orders)
    accounts, side = AD.accounts(spark, sf_dir, orders), AD.side_ledger(spark, sf_dir, orders)
    if laid is not None:
        accounts = accounts.persist(StorageLevel.DISK_ONLY)
        kept.append(accounts)

    def trigrams():
        counts = SQ.trigram_counts(SQ.trigrams(txn, hot=hot))
        return SQ.trigram_features(counts, SQ.trigram_enrichment(counts, labels), accounts)

    def distinct():
        if laid is None:
            return AC.distinct_counts(AD.lineitem_ledger(spark, sf_dir, mcc=True))
        counts = laid_mcc_counts(spark, sf_dir, laid, rows)
        kept.append(counts)
        known = laid.filter(F.col("part_key").isNotNull())
        if counts.agg(F.sum("missing")).first()[0]:  # lines without their part count for nothing here
            parts = AD.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"))
            known = known.join(parts, "part_key", "left_semi")
        return AC.distinct_counts(known, mcc_counts=counts)

    builders = {
        "distinct": distinct,
        "gaps": lambda: SQ.gap_stats(SQ.gaps(txn, hot=hot)),
        "dwell": lambda: AC.median_dwell(SQ.dwell_pairs(txn, hot=hot)),
        "trigrams": trigrams,
        "balance": lambda: AC.balance_dynamics(side),
        "geo": lambda: AC.geo_spread(side),
        "flags": lambda: AC.account_flags(accounts),
        "encode": lambda: encoded_labels(labels),
    }
    return [*profile_group(txn, accounts, wanted), *[builders[g]() for g in wanted if g in builders]]


def profile_group(txn: DataFrame, accounts: DataFrame, wanted: Sequence[str]) -> list[DataFrame]:
    """Counts, volumes, first large amount and resting balance from a single scan of the ledger."""
    derived = {"life": ("first_large", "opening_date"), "residual": ("core", "daily_avg_balance")}
    parts = [p for p in AC.PROFILE_PARTS if p in wanted or any(p == derived[g][0] for g in derived if g in wanted)]
    if not parts:
        return []
    group = AC.account_profile(txn, parts)
    extra = [g for g in derived if g in wanted]
    if extra:
        group = accounts.select(A, *[derived[g][1] for g in extra]).join(group, A, "left")
        values = {"life": ("days_to_first_large", AC.days_to_first_large), "residual": ("residual_ratio", AC.residual_ratio)}
        group = group.withColumns({values[g][0]: values[g][1]() for g in extra}).drop(*[derived[g][1] for g in extra])
    return [group]


def features(spark: SparkSession, sf_dir: str, groups: Sequence[str] = ALL_GROUPS, kept: list[DataFrame] | None = None) -> DataFrame:
    universe = AD.labels(spark, sf_dir).drop("branch_code")
    return assemble_features(universe, feature_groups(spark, sf_dir, groups, kept))


def stored_features(spark: SparkSession, sf_dir: str, groups: Sequence[str] = ALL_GROUPS) -> DataFrame:
    """The feature table written once to the shared folder, for steps that read it several times.

    It is read in no more partitions than it needs: trees are grown with one table of sums per partition and level.
    """
    kept: list[DataFrame] = []
    stored = cut_lineage(features(spark, sf_dir, groups, kept))
    for df in kept:
        df.unpersist()
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return stored.coalesce(max(usual, -(-stored.count() // STORED_ROWS)))


def signal_table(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """Features with the twelve signals and their summary; thresholds from training rows only."""
    groups = [g for g in ALL_GROUPS if g in SIGNAL_GROUPS or g in extra]
    feat = stored_features(spark, sf_dir, groups)
    flagged = DE.signals(feat, DE.signal_thresholds(feat.filter(~F.col("is_test"))))
    return DE.signal_summary(flagged)
