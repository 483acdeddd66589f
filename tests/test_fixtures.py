"""Small hand-worked cases that the given tables do not cover."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgersignal.functions import scalars as S
from ledgersignal.operators import account as AC
from ledgersignal.operators import betweenness as BW
from ledgersignal.operators import derived as DE
from ledgersignal.operators import encode as EN
from ledgersignal.operators import evaluate as EV
from ledgersignal.operators import network as NW
from ledgersignal.operators import ranking as RK
from ledgersignal.operators import reports as RE
from ledgersignal.operators import sequence as SQ
from ledgersignal.operators import windows as WI
from ledgersignal.session import cut_lineage

T0 = dt.datetime(2024, 1, 1, 12)
LEDGER = "account_id string, txn_id int, ts timestamp_ntz, amount double, txn_type string, channel string, counterparty_id string, mcc_code string"


def ledger(spark, rows):
    """rows: (hours, signed amount[, channel, counterparty, mcc])"""
    full = []
    for i, r in enumerate(rows):
        h, amount, channel, cp, mcc = (*r, *(("UPI", "CP1", "5411")[len(r) - 2:]))
        full.append(("A", i, None if h is None else T0 + dt.timedelta(hours=h), float(amount), "C" if amount > 0 else "D", channel, cp, mcc))
    return spark.createDataFrame(full, LEDGER)


def one(df):
    return df.first().asDict()


def test_round_and_band_flags(spark):
    amounts = [1000, 5000, 10000, 50000, 100000, 12000, 12500, 49999.50, 48000, 45000, 50000]
    t = ledger(spark, [(i, a) for i, a in enumerate(amounts)])
    r = one(AC.account_profile(t))
    assert r["round_count"] == 6 and r["near_threshold_count"] == 3
    assert r["struct_48_50_pct"] == pytest.approx(2 / 11)
    assert r["exact_round_pct"] == pytest.approx(5 / 11)
    assert r["large_round_pct"] == pytest.approx(7 / 11)
    assert t.filter(S.is_large(F.col("amount"))).count() == 1
    assert t.filter(S.is_large_ge(F.col("amount"))).count() == 3


def test_null_keys(spark):
    t = ledger(spark, [(0, 10, None, None, None), (1, 20, "UPI", "X", None), (2, -5, "UPI", "X", "M"), (3, -5, "ATM", "Y", "M"), (4, 5, "ATM", None, "N")])
    r = one(AC.distinct_counts(t))
    assert (r["degree_centrality"], r["credit_cp_n"], r["debit_cp_n"], r["mcc_nunique"], r["channel_diversity"]) == (2, 1, 2, 2, 2)
    assert one(AC.counterparty_entropy(t))["counterparty_entropy"] == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    assert one(AC.mcc_entropy(t))["mcc_entropy"] is None
    first = SQ.trigrams(t).orderBy("trigram").collect()
    assert "C_nan|C_UPI|D_UPI" in [x["trigram"] for x in first]
    z = one(AC.mcc_anomaly(t, AC.mcc_global_stats(t)))
    assert z["mcc_zscore_gt2"] == 0


def test_ties_are_ordered_by_id(spark):
    t = ledger(spark, [(0, 60000), (0, -60000), (0, 60000), (5, -60000)])
    pairs = [(r["txn_id"], r["dwell_hours"]) for r in SQ.dwell_pairs(t).orderBy("txn_id").collect()]
    assert pairs == [(0, 0.0), (2, 5.0)]


@pytest.mark.parametrize(
    "moves, expected",
    [([60000, 60000, -60000], [1.0]), ([60000, -60000, -60000], [1.0]), ([-60000, 60000], []), ([60000, -100, -60000], [2.0]), ([50000, -50000], [1.0])],
)
def test_dwell(spark, moves, expected):
    t = ledger(spark, list(enumerate(moves)))
    assert [r["dwell_hours"] for r in SQ.dwell_pairs(t).collect()] == expected
    assert [r["dwell_hours"] for r in SQ.dwell_state_pairs(t).collect()] == expected


def test_passthrough_within_hours(spark):
    t = ledger(spark, [(0, 1000), (10, 500), (20, -1010), (100, 300), (200, -300)])
    got = {r["txn_id"]: (r["passthrough_hours"], r["amount_match"]) for r in SQ.passthrough_pairs(t).collect()}
    assert got == {0: (20.0, 1), 1: (10.0, 0)}


def test_salary(spark):
    one_month = ledger(spark, [(0, 100), (24, 200)])
    assert one(AC.salary_regularity(one_month)) == {"account_id": "A", "salary_irregularity": 0.0, "months_with_credits": 1}
    four = ledger(spark, [(0, 100), (24 * 31, 100), (24 * 62, 100), (24 * 93, 500)])
    assert one(AC.salary_regularity(four))["salary_irregularity"] == pytest.approx(1.0)


def test_geo_and_balance(spark):
    schema = "account_id string, ts timestamp_ntz, transaction_id int, latitude double, longitude double, balance_after_transaction double"
    side = spark.createDataFrame(
        [
            ("one", T0, 1, 10.0, 20.0, 5.0),
            ("two", T0, 1, 10.0, 20.0, 5.0),
            ("two", T0, 2, 11.5, 19.0, -5.0),
            ("two", T0, 3, None, 50.0, 0.0),
            ("two", T0, 4, 11.5, 19.0, None),
            ("two", T0, 5, 11.5, 19.0, 7.0),
        ],
        schema,
    )
    geo = {r["account_id"]: r for r in AC.geo_spread(side).collect()}
    assert geo["one"]["geo_spread_lat"] is None and geo["one"]["geo_unique_locations"] == 1
    assert (geo["two"]["geo_spread_lat"], geo["two"]["geo_spread_lon"], geo["two"]["geo_spread_total"], geo["two"]["geo_unique_locations"]) == (1.5, 1.0, 2.5, 2)
    bal = {r["account_id"]: r for r in AC.balance_dynamics(side).collect()}
    assert bal["one"]["zero_crossings"] is None and bal["two"]["zero_crossings"] == 3 and bal["two"]["balance_min"] == -5.0


def test_account_flags_and_age(spark):
    d = dt.date(2024, 1, 10)
    acc = spark.createDataFrame([("a", d, None, None, d, None, "frozen"), ("b", None, d, d, None, d, "x")], "account_id string, freeze_date date, unfreeze_date date, last_mobile_update_date date, last_kyc_date date, opening_date date, account_status string")
    flags = {r["account_id"]: r.asDict() for r in AC.account_flags(acc).collect()}
    assert flags["a"] == {"account_id": "a", "has_prior_freeze": 1, "has_unfreeze": 0, "is_frozen": 1, "has_mobile_update": 0}
    ages = {r["account_id"]: r for r in AC.account_age(acc, "2024-01-20").collect()}
    assert (ages["a"]["kyc_age_days"], ages["a"]["account_age_days"], ages["b"]["kyc_age_days"]) == (10, 9999, 9999)
    win = spark.createDataFrame([("a", 19700, 19730), ("b", 19700, 19710)], "account_id string, start_day bigint, end_day bigint")
    frozen = {r["account_id"]: r["end_day"] for r in WI.window_freeze_anchor(win, acc, "truncate").collect()}
    assert frozen == {"a": 19730, "b": 19710}
    early = win.withColumn("start_day", F.lit(19720).cast("bigint")).withColumn("end_day", F.lit(19740).cast("bigint"))
    assert {r["account_id"]: r["end_day"] for r in WI.window_freeze_anchor(early, acc, "truncate").collect()} == {"a": 19732, "b": 19740}


def test_kyc_and_demographics(spark):
    link = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "c"), ("c3", "d")], "customer_id string, account_id string")
    cust = spark.createDataFrame([("c1", "Y"), ("c2", None)], "customer_id string, aadhaar_available string")
    assert {r[0]: r[1] for r in AC.kyc_flags(cust, link).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    demo = spark.createDataFrame([("c1", "p1", "Y", "N", "M"), ("c2", None, "N", "Y", "F"), ("c3", "p1", None, None, None)], "customer_id string, phone string, joint_account_flag string, nri_flag string, gender string")
    assert {r["account_id"]: r["shared_phone_count"] for r in AC.share_counts(AC.customer_bridge(demo, link), {"shared_phone_count": ["phone"]}).collect()} == {"a": 3, "b": 3, "c": None, "d": 3}
    assert {r["account_id"]: (r["is_joint"], r["is_nri"], r["is_male"]) for r in AC.demographic_flags(demo, link).collect()}["d"] == (0, 0, 0)


def daily(spark, days):
    """{account: {day: volume}}"""
    rows = [(a, d, v, 1) for a, s in days.items() for d, v in s.items()]
    return spark.createDataFrame(rows, "account_id string, day_no bigint, v bigint, n bigint")


def bounds(df):
    return {r["account_id"]: (r["start_day"], r["end_day"]) for r in df.collect()}


def test_window_minimum_days_and_ties(spark):
    series = {"one": {5: 10}, "two": {5: 10, 6: 20}, "flat": {d: 10 for d in range(0, 100, 5)}, "zero": {1: 0, 2: 0, 3: 0}, "burst": {**{d: 1 for d in range(0, 700, 30)}, **{d: 1000 for d in range(400, 410)}}}
    d = daily(spark, series)
    seven = bounds(WI.window_multiscale(d))
    assert "one" not in seven and "two" not in seven and "zero" not in seven
    assert seven["burst"] == (400, 409)
    assert seven["flat"][0] == 0  # equal windows: the earliest start wins
    assert set(bounds(WI.window_v9(d))) == {"two", "flat", "burst"}
    assert bounds(WI.window_smoothed_v10(d))["two"] == (5 - 3, 6 + 3)
    assert set(bounds(WI.window_two_pass_z(d))) == {"flat", "burst"}
    assert set(bounds(WI.window_30d_p75(d))) == {"flat", "burst"}


def plain_densest(series, width):
    best = None
    for start in sorted(series):
        days = [x for x in series if start <= x <= start + width]
        total = sum(series[x] for x in days)
        if best is None or total > best[0]:
            best = (total, start, max(days))
    return best


def plain_multiscale(series, scales, coverage, trim):
    total = sum(series.values())
    lo, hi = min(series), max(series)
    for w in scales:
        vol, s, e = plain_densest(series, w)
        if 100 * vol >= coverage * total:
            lo, hi = s, e
            break
    inside = sorted(x for x in series if lo <= x <= hi)
    if len(inside) > 5:
        tot, cum, out = sum(series[x] for x in inside), 0, []
        for x in inside:
            before, cum = cum, cum + series[x]
            out.append((x, cum))
        return next(x for x, c in out if 100 * c >= trim[0] * tot), next(x for x, c in out if 100 * c >= trim[1] * tot)
    return lo, hi


def test_multiscale_equals_plain_loop(spark):
    rnd = random.Random(3)
    series = {f"a{i}": {rnd.randrange(0, 30 * (i % 9 + 1)): rnd.choice([5, 50, 50, 500, 9000]) for _ in range(rnd.randrange(3, 40))} for i in range(60)}
    series = {a: s for a, s in series.items() if len(s) >= 3}
    expected = {a: plain_multiscale(s, (14, 30, 60, 90), 50, (5, 95)) for a, s in series.items()}
    assert bounds(WI.window_multiscale(daily(spark, series))) == expected


def test_windows_stay_inside_the_series(spark):
    rnd = random.Random(5)
    series = {f"a{i}": {rnd.randrange(0, 1500): rnd.randrange(1, 900) for _ in range(60)} for i in range(25)}
    d = daily(spark, series).cache()
    for op in (WI.window_adaptive_cdf, WI.window_tight_v6, WI.window_two_pass_z, WI.window_core_expand_v11, WI.window_30d_p75, WI.window_cdf):
        for a, (s, e) in bounds(op(d)).items():
            assert min(series[a]) <= s <= e <= max(series[a])
    assert all(e - s <= 400 for s, e in bounds(WI.window_tight_v6(d)).values())


def test_temporal_iou(spark):
    p = spark.createDataFrame([("a", 1, 10), ("b", 1, 5), ("c", 1, 5)], "account_id string, start_day bigint, end_day bigint")
    t = spark.createDataFrame([("a", 6, 15), ("b", 10, 12)], "account_id string, start_day bigint, end_day bigint")
    assert {r[0]: r[1] for r in WI.temporal_iou(p, t).collect()} == {"a": pytest.approx(5 / 15), "b": 0.0, "c": 0.0}


SCORES = [(0.9, 1), (0.8, 1), (0.8, 0), (0.5, 1), (0.5, 0), (0.5, 0), (0.2, 0), (0.1, 1)]


def score_frame(spark):
    return spark.createDataFrame([(str(i), s, y) for i, (s, y) in enumerate(SCORES)], "account_id string, score double, is_mule int")


def test_auc_and_thresholds_by_hand(spark):
    df = score_frame(spark)
    pos, neg = [s for s, y in SCORES if y], [s for s, y in SCORES if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert one(EV.auc(df))["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    table = {round(r["threshold"], 3): r for r in EV.threshold_table(df, EV.grid_points(0.1, 0.95, 0.05)).collect()}
    for t, r in table.items():
        assert r["tp"] == sum(s > t and y for s, y in SCORES) and r["fp"] == sum(s > t and not y for s, y in SCORES)
    cm = one(EV.confusion(df, 0.5))
    assert (cm["tp"], cm["fp"], cm["fn"], cm["tn"]) == (2, 1, 2, 3) and cm["precision"] == pytest.approx(2 / 3) and cm["f2"] == pytest.approx(10 / 19)
    assert [r["tp"] + r["fp"] for r in EV.pr_curve(df).orderBy(F.desc("threshold")).collect()] == [1, 3, 6, 7, 8]
    hist = RE.score_histogram(df, 4).orderBy("bin").collect()
    assert [r["n_rows"] for r in hist] == [2, 0, 3, 3]


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 10.0), ("e", None)], "account_id string, x double")
    got = {r["account_id"]: r["x_rank"] for r in RK.rank_columns(df, "account_id", {"x": F.col("x")}).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": 0.5}
    q = RK.exact_quantiles(df, {"x": F.col("x")}, [0.9]).first()["quantile"]
    assert q == pytest.approx(7.6)


def test_oof_ignores_own_fold(spark):
    rows = [(str(i), "k1" if i % 2 else "k2", int(i % 5 == 0), i % 3) for i in range(30)]
    schema = "account_id string, key string, y int, fold bigint"
    flip = [(a, k, 1 - y if a == "7" else y, f) for a, k, y, f in rows]

    def rates(data):
        df = spark.createDataFrame(data, schema)
        return {r["account_id"]: r["rate_oof"] for r in EN.target_encode_oof(df, None, "key", "y", "fold", alpha=0.0).collect()}

    before, after = rates(rows), rates(flip)
    own = [a for a, k, _, f in rows if k == "k1" and f == 7 % 3]
    other = [a for a, k, _, f in rows if k == "k1" and f != 7 % 3]
    assert all(before[a] == after[a] for a in own) and all(before[a] != after[a] for a in other)


def test_encoding_of_unseen_and_missing_keys(spark):
    train = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("c", None, 1)], "account_id string, key string, y int")
    rows = spark.createDataFrame([("p", "x"), ("q", "new"), ("r", None)], "account_id string, key string")
    got = {r["account_id"]: r["rate"] for r in EN.target_encode(train, rows, "key", "y").collect()}
    mu = 2 / 3
    assert got == {"p": pytest.approx((1 + 10 * mu) / 12), "q": pytest.approx(mu), "r": pytest.approx(mu)}


def test_single_class_folds_are_dropped(spark):
    df = spark.createDataFrame([(str(i), i // 4, int(i > 7)) for i in range(24)], "account_id string, bucket bigint, y int")
    assert sorted(r["fold"] for r in EN.usable_folds(df, "y", "bucket", 5).collect()) == [3, 4, 5]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, 1) for a, b in pairs], "src string, dst string, total_volume double, txn_count bigint")


GRAPH = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("h", "l1"), ("h", "l2"), ("h", "l3"), ("h", "l4"), ("h", "l5"), ("a", "a")]


def test_clustering_and_components(spark):
    got = {r["node"]: (r["triangles"], round(r["clustering"], 4)) for r in NW.clustering(edges(spark, GRAPH)).collect()}
    assert got["a"] == (1, 1.0) and got["c"] == (1, 0.3333) and got["d"] == (0, 0.0) and got["h"] == (0, 0.0)
    comp = {r["node"]: (r["component"], r["component_size"]) for r in NW.connected_components(edges(spark, GRAPH)).collect()}
    assert comp["d"] == ("a", 4) and comp["y"] == ("x", 2) and comp["l5"] == ("h", 6)
    chain = {r["node"]: r["component"] for r in NW.connected_components(edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)])).collect()}
    assert set(chain.values()) == {"n00"}


def test_pagerank_converges_to_stationary(spark):
    ranks = {r["node"]: r["pagerank"] for r in NW.pagerank(edges(spark, GRAPH), tol=1e-9).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0, abs=1e-9)
    assert ranks["x"] == pytest.approx(1 / len(ranks), abs=1e-6) and ranks["h"] == max(ranks.values())


def test_betweenness_equals_path_counting(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")]
    nodes = sorted({n for p in pairs for n in p})
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in nodes}

    def paths(s, t):
        level = [[s]]
        while level:
            hits = [p for p in level if p[-1] == t]
            if hits:
                return hits
            level = [p + [n] for p in level for n in near[p[-1]] if n not in p]
        return []

    expected = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            if s != t:
                found = paths(s, t)
                for p in found:
                    for n in p[1:-1]:
                        expected[n] += 1 / len(found)
    n = len(nodes)
    got = {r["node"]: r["betweenness"] for r in NW.betweenness_sampled(edges(spark, pairs), k=n).collect()}
    assert got == {k: pytest.approx(v / ((n - 1) * (n - 2))) for k, v in expected.items()}


def test_betweenness_over_strips_makes_no_row_per_source_and_node(spark, monkeypatch):
    for name, size in (("LANES", 8), ("STRIP", 16), ("BLOCK", 32), ("PIECE_EDGES", 64), ("SLICE", 16)):
        monkeypatch.setattr(BW, name, size)
    written = []
    monkeypatch.setattr(BW, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    draw = random.Random(3)
    n = 70
    pairs = {tuple(sorted(draw.sample(range(n), 2))) for _ in range(110)} | {(i, 80) for i in range(25)} | {(90, 91)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = dict.fromkeys(near, 0.0)
    for s in near:
        depth, sigma, queue = {s: 0}, {s: 1.0}, [s]
        for v in queue:
            for w in near[v]:
                if w not in depth:
                    depth[w], sigma[w] = depth[v] + 1, 0.0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(queue, 0.0)
        for w in reversed(queue):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                expected[w] += delta[w]
    got = {r["node"]: r["betweenness"] for r in NW.betweenness_sampled(edges(spark, sorted(pairs)), k=len(near)).collect()}
    count = len(near)
    assert got == {str(v): pytest.approx(x / ((count - 1) * (count - 2))) for v, x in expected.items()}
    assert written and max(df.count() for df in written) <= 2 * len(pairs)
    assert NW.betweenness_sampled(edges(spark, sorted(pairs)).limit(0)).count() == 0


def test_shared_network_by_sets(spark):
    pairs = [("a", "p"), ("b", "p"), ("c", "p"), ("c", "q"), ("d", "q"), ("e", "r"), ("d", "s"), ("b", "s")]
    labels = spark.createDataFrame([(x, int(x in "bd")) for x in "abcde"], "account_id string, is_mule int")
    cps = {a: {q for x, q in pairs if x == a} for a in "abcde"}
    got = {r["account_id"]: (r["shared_network_size"], r["shared_mule_neighbors"]) for r in NW.shared_network(edges(spark, pairs), labels).collect()}
    for a in "abcde":
        others = {b for b in "abcde" if b != a and cps[a] & cps[b]}
        assert got[a] == (len(others), len(others & {"b", "d"}))


def test_shared_network_over_blocks_ships_no_bitmaps(spark):
    n = 2 * NW.BLOCK + 10
    even = spark.range(n).select(F.col("id").alias("src"), (-1 - F.col("id") % 2).alias("dst"))
    last = spark.createDataFrame([(n - 1, -3), (0, -3)], "src bigint, dst bigint")
    e = even.unionByName(last).withColumns({"total_volume": F.lit(1.0), "txn_count": F.lit(1)})
    labels = spark.range(n).select(F.col("id").alias("account_id"), (F.col("id") % 10 == 0).cast("int").alias("is_mule"))
    out = NW.shared_network(e, labels)
    assert "bitmap_or_agg" not in out._jdf.queryExecution().toString()
    got = {r["account_id"]: (r["shared_network_size"], r["shared_mule_neighbors"]) for r in out.collect()}
    mules = len(range(0, n, 10))
    assert len(got) == n
    assert got[0] == (n // 2, mules - 1) and got[n - 1] == (n // 2, 1)
    assert got[2] == (n // 2 - 1, mules) and got[10] == (n // 2 - 1, mules - 1) and got[n - 3] == (n // 2 - 1, 0)


def test_exposure(spark):
    labels = spark.createDataFrame([("a", 0), ("m", 1), ("n", 1)], "account_id string, is_mule int")
    e = spark.createDataFrame([("a", "m", 30.0, 1), ("a", "z", 70.0, 1), ("m", "n", 5.0, 1), ("n", "a", 0.5, 1)], "src string, dst string, total_volume double, txn_count bigint")
    got = {r["account_id"]: r for r in NW.mule_exposure(e, labels, labels).collect()}
    assert (got["a"]["cp_mule_count"], got["a"]["cp_mule_rate"], got["a"]["cp_mule_vol_pct"], got["a"]["cp_internal_count"]) == (1, 0.5, 0.3, 1)
    hop = {r["account_id"]: r["cp_2hop_mule_count"] for r in NW.two_hop_exposure(e, labels).collect()}
    assert hop == {"a": 1, "m": 0, "n": 0}


def test_tail_is_padded_in_front(spark):
    t = ledger(spark, [(0, 10), (2, -20), (5, 30)])
    r = one(SQ.tail_sequence(SQ.tail_rows(t, 2), 4))
    assert r["length"] == 2 and [s["dir"] for s in r["steps"]] == [0.0, 0.0, -1.0, 1.0] and [s["time_delta"] for s in r["steps"]] == [0.0, 0.0, 2.0, 3.0]


def test_composite_and_drop_degenerate(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 5.0)], "account_id string, x double, y double")
    got = {r["account_id"]: r["composite_score"] for r in DE.composite_score(df, ["x", "y"]).collect()}
    assert got["c"] == 0.0 and got["a"] == pytest.approx(-got["b"]) and got["b"] == pytest.approx(1 / math.sqrt(2))
    assert S.drop_degenerate(df, ["x", "y"]).columns == ["account_id", "x"]


def test_ks_between_halves(spark):
    series = {"s": {d: (10 if d < 5 else 99) for d in range(10)}, "t": {d: 10 + d % 2 for d in range(8)}, "few": {1: 1, 2: 2}}
    got = {r[0]: r[1] for r in AC.ks_phase_shift(daily(spark, series)).collect()}
    assert got == {"s": 1.0, "t": 0.0}
