"""From raw bank tables to the feature table, and from features to scored accounts with intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators import account as AC
from ledgersignal.operators import derived as DE
from ledgersignal.operators import encode as EN
from ledgersignal.operators import evaluate as EV
from ledgersignal.operators import reports as RE
from ledgersignal.operators import scoring as SC
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import windows as WI
from ledgersignal.operators.skew import hot_accounts
from ledgersignal.plans.feature_table import assemble_features, profile_group
from ledgersignal.session import cut_lineage
from ledgersignal.sources import readers as RD

A = "account_id"
ACCOUNT_DATES = ("account_opening_date", "freeze_date", "unfreeze_date", "last_mobile_update_date", "last_kyc_date")
SCHEMES = ("PMJDY",)
PROFILE = ("core", "flow", "behaviour", "refined", "life", "residual")


def prepared_accounts(raw: DataFrame) -> DataFrame:
    return RD.parse_dates(raw, ACCOUNT_DATES).withColumnRenamed("account_opening_date", "opening_date")


def _one_row(group: DataFrame) -> DataFrame:
    """Customer-level groups may repeat an account through several linkage rows: keep the highest flags."""
    return group.groupBy(A).agg(*[F.max(c).alias(c) for c in group.columns if c != A])


def ledger_groups(txn: DataFrame, accounts: DataFrame, labels: DataFrame) -> list[DataFrame]:
    hot = hot_accounts(txn)
    counts = SQ.trigram_counts(SQ.trigrams(txn, hot=hot))
    return [
        *profile_group(txn, accounts, PROFILE),
        AC.fan_ratio(AC.distinct_counts(txn)),
        AC.counterparty_entropy(txn),
        AC.mcc_entropy(txn),
        SQ.gap_stats(SQ.gaps(txn, hot=hot)),
        AC.median_dwell(SQ.dwell_pairs(txn, hot=hot)),
        AC.salary_regularity(txn),
        AC.mcc_anomaly(txn, AC.mcc_global_stats(txn)),
        AC.ks_phase_shift(AC.daily_series(txn)),
        SQ.trigram_features(counts, SQ.trigram_enrichment(counts, labels), accounts),
    ]


def side_groups(txn: DataFrame, side: DataFrame) -> list[DataFrame]:
    """Groups of the side ledger, which finds its account through the transaction id."""
    owner = txn.select(F.col("txn_id").alias("transaction_id"), A, "ts")
    joined = SQ.attach_side_ledger(side, owner)
    return [AC.ip_diversity(joined), AC.geo_spread(joined), AC.balance_dynamics(joined), AC.code_shares(joined)]


def static_groups(dims: dict[str, DataFrame], accounts: DataFrame, as_of: str) -> list[DataFrame]:
    linkage = dims["linkage"]
    people = AC.customer_bridge(dims["demographics"], linkage)
    shared = AC.share_counts(people, {"shared_phone_count": ["phone_number"], "shared_address_count": ["address"]})
    schemes = S.one_hot(dims["accounts_additional"], "scheme_code", SCHEMES, "scheme")
    return [
        AC.account_flags(accounts),
        AC.account_age(accounts, as_of),
        AC.branch_profile(accounts, dims["branch"]),
        _one_row(AC.kyc_flags(dims["customers"], linkage)),
        _one_row(AC.demographic_flags(dims["demographics"], linkage)),
        _one_row(shared),
        _one_row(schemes.select(A, *[f"scheme_{v}" for v in SCHEMES])),
    ]


def bank_features(txn: DataFrame, side: DataFrame, dims: dict[str, DataFrame], as_of: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row per labelled or test account: all groups, encodings, interactions and composite score."""
    accounts = prepared_accounts(dims["accounts"])
    labels = dims["labels"].select(A, "is_mule")
    ids = RD.universe(labels, dims["test_accounts"])
    txn = RD.scan_for_accounts(txn, ids)
    branch = accounts.select(A, "branch_code")
    train = EN.stratified_folds(labels.join(branch, A, "left"), folds, seed)
    test = dims["test_accounts"].select(A).join(branch, A, "left")
    encoded = EN.target_encode_oof(train, test, "branch_code", "is_mule", "fold", name="branch_mule_rate_oof", full_name="branch_mule_rate")
    groups = [*ledger_groups(txn, accounts, labels), *side_groups(txn, side), *static_groups(dims, accounts, as_of)]
    feat = cut_lineage(assemble_features(encoded.drop("branch_code"), groups))
    feat = DE.interactions_h42(feat)
    return DE.composite_score(feat, DE.COMPOSITE_OOF, feat.filter(F.col("is_mule").isNotNull()))


def numeric_features(feat: DataFrame) -> list[str]:
    """Columns a model may use; ids, labels, folds and the leaky branch rate are left out."""
    skip = {A, "is_mule", "fold", "branch_mule_rate", "is_test"}
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in feat.dtypes if c not in skip and (t in numeric or t.startswith("decimal"))]


def score_and_locate(
    feat: DataFrame,
    txn: DataFrame,
    make: Callable[[], Estimator],
    features: Sequence[str],
    folds: int,
    gate: float = 0.25,
    beta_weights: tuple[float, float] = (0.0, 1.0),
    scales: Sequence[int] = (14, 30, 60, 90),
) -> DataFrame:
    """Out-of-fold model, best threshold, and an interval for every test account above the gate.

    Rows of ``feat`` without a label are the test accounts. Only model parameters and one threshold
    pass through the driver.
    """
    train, test = feat.filter(F.col("is_mule").isNotNull()), feat.filter(F.col("is_mule").isNull())
    data = SC.vectorised(train, features)
    held = SC.vectorised(test.withColumn("is_mule", F.lit(0)), features).select(A, "features")
    oof, scored = SC.oof_scores(data, make, folds, "score", test=held)
    threshold = EV.threshold_sweep(train.select(A, "is_mule").join(oof, A), EV.grid_points(0.10, 0.95, 0.005), beta_weights).first()["threshold"]
    scored = cut_lineage(scored)
    daily = AC.daily_series(txn, WI.gate(scored, threshold, gate))
    return RE.assemble_submission(test, scored, WI.window_multiscale(daily, scales))
