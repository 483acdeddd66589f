"""Queries over suspicious-interval detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgersignal.operators import account as AC
from ledgersignal.operators import windows as WI
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.ledger_queries import DAILY_E, DAILY_L
from ledgersignal.plans.registry import query
from ledgersignal.sources import adapters as AD

A = "account_id"
BOUNDS = "account_id start_day end_day"

# Days merged ten to one: shorter lives, so that the branches for young accounts are taken too.
DAILY_SHORT = DAILY_L.replace("daily AS", "full_daily AS") + ", daily AS (SELECT account_id, day_no // 10 AS day_no, CAST(sum(v) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS n FROM full_daily GROUP BY ALL)"


def daily_lines(spark, sf):
    return AC.daily_series(AD.lineitem_ledger(spark, sf))


def daily_short(spark, sf):
    day = F.floor(F.col("day_no") / 10).cast("bigint").alias("day_no")
    return daily_lines(spark, sf).groupBy(A, day).agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def daily_events(spark, sf):
    return AC.daily_series(AD.event_ledger(spark, sf))


def totals(min_days: int, v: str = "v", source: str = "daily") -> str:
    return f"""base AS (SELECT * FROM (SELECT *, sum({v}) OVER p AS total, count(*) OVER p AS n_days, min(day_no) OVER p AS first_day, max(day_no) OVER p AS last_day
      FROM {source} WINDOW p AS (PARTITION BY account_id)) WHERE n_days >= {min_days} AND total > 0)"""


def best(name: str, days: int, source: str = "base", v: str = "v") -> str:
    """CTE with each account's densest window, from a direct range frame."""
    return f"""{name} AS MATERIALIZED (SELECT account_id, wv AS vol, day_no AS s, we AS e FROM (
      SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY wv DESC, day_no) AS rn FROM (
        SELECT account_id, day_no, sum({v}) OVER r AS wv, max(day_no) OVER r AS we FROM {source}
        WINDOW r AS (PARTITION BY account_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND {days} FOLLOWING))) WHERE rn = 1)"""


def cdf(source: str, name: str = "cum_t") -> str:
    return f"{name} AS (SELECT *, sum(v) OVER (PARTITION BY account_id ORDER BY day_no) AS cum, sum(v) OVER (PARTITION BY account_id) AS tot FROM {source})"


def qday(p: int) -> str:
    return f"min(CASE WHEN 100 * cum >= {p} * tot THEN day_no END)"


def multiscale(daily: str, scales, coverage, trim, min_days, trim_min, fallback=None, ordered=False) -> str:
    tables = [best(f"b{w}", w) for w in scales] + ([best(f"b{fallback}", fallback)] if fallback and fallback not in scales else [])
    used = [*scales] + ([fallback] if fallback and fallback not in scales else [])
    joins = " ".join(f"JOIN b{w} USING (account_id)" for w in used)

    def pick(col, other):
        whens = " ".join(f"WHEN 100 * b{w}.vol >= {coverage} * total THEN {col.replace('@', f'b{w}').replace('#', str(w))}" for w in scales)
        return f"CASE {whens} ELSE {other} END"

    fb = f"b{fallback}" if fallback else None
    chosen = f"""chosen AS MATERIALIZED (SELECT account_id, total, n_days, {pick('@.s', f'{fb}.s' if fb else 'first_day')} AS cs, {pick('@.e', f'{fb}.e' if fb else 'last_day')} AS ce,
      {pick('#', str(fallback) if fb else 'NULL')} AS scale_days, {pick('@.vol', f'{fb}.vol' if fb else 'total')} AS cvol
      FROM (SELECT DISTINCT account_id, total, n_days, first_day, last_day FROM base) {joins})"""
    inside = "inside AS MATERIALIZED (SELECT base.account_id, day_no, v, cs, ce, scale_days, cvol, chosen.total AS ctotal, chosen.n_days AS cn FROM base JOIN chosen USING (account_id) WHERE day_no BETWEEN cs AND ce)"
    cut = f"count(*) >= {trim_min}" + (f" AND {qday(trim[1])} > {qday(trim[0])}" if ordered else "")
    body = f"""SELECT account_id, CASE WHEN {cut} THEN {qday(trim[0])} ELSE any_value(cs) END AS start_day, CASE WHEN {cut} THEN {qday(trim[1])} ELSE any_value(ce) END AS end_day,
      any_value(scale_days) AS scale_days, any_value(cvol / ctotal) AS coverage, any_value(cn) AS n_days FROM cum_t GROUP BY account_id"""
    return O.with_(body, daily, totals(min_days), *tables, chosen, inside, cdf("inside"))


@query("window_minmax", i=BOUNDS, sql=O.with_("SELECT account_id, min(day_no) AS start_day, max(day_no) AS end_day FROM daily GROUP BY account_id", DAILY_E))
def _(spark, sf):
    return WI.window_minmax(AD.event_ledger(spark, sf))


def two_pass_sql(daily: str) -> str:
    z = lambda n, name, src: f"""CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY day_no) > {n} AND {n} * sum(CAST(v AS HUGEINT) * v) OVER f - sum(CAST(v AS HUGEINT)) OVER f * sum(CAST(v AS HUGEINT)) OVER f > 0
        THEN ({n} * v - sum(v) OVER f) / sqrt(CAST({n} * sum(CAST(v AS HUGEINT) * v) OVER f - sum(CAST(v AS HUGEINT)) OVER f * sum(CAST(v AS HUGEINT)) OVER f AS DOUBLE)) ELSE 0 END AS {name}
      FROM {src} WINDOW f AS (PARTITION BY account_id ORDER BY day_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"""  # noqa: E731
    return O.with_(
        """SELECT account_id, CASE WHEN any_value(nf) < 5 THEN any_value(cs) ELSE min(day_no) FILTER (ff) END AS start_day, CASE WHEN any_value(nf) < 5 THEN any_value(ce) ELSE max(day_no) FILTER (ff) END AS end_day FROM f3 GROUP BY account_id""",
        daily,
        totals(10),
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY day_no) AS rn FROM base)",
        f"c1 AS (SELECT *, {z(30, 'zc', 'numbered')})",
        "c2 AS (SELECT *, CASE WHEN max(zc) OVER p > 2 THEN zc > 2 ELSE v >= quantile_cont(v, 0.95) OVER p END AS cf FROM c1 WINDOW p AS (PARTITION BY account_id))",
        "span AS (SELECT account_id, min(rn) FILTER (cf) AS lo, max(rn) FILTER (cf) AS hi, min(day_no) FILTER (cf) AS cs, max(day_no) FILTER (cf) AS ce FROM c2 GROUP BY account_id)",
        "sl AS (SELECT c2.*, cs, ce FROM c2 JOIN span USING (account_id) WHERE rn >= lo - 15 AND rn <= hi + 14)",
        f"f1 AS (SELECT *, {z(3, 'zf', 'sl')})",
        "f3 AS (SELECT *, count(*) OVER p AS nf, CASE WHEN max(zf) OVER p > 1.5 THEN zf > 1.5 ELSE v >= quantile_cont(v, 0.8) OVER p END AS ff FROM f1 WINDOW p AS (PARTITION BY account_id))",
    )


@query("window_two_pass_z", i=BOUNDS, sql=two_pass_sql(DAILY_L))
def _(spark, sf):
    return WI.window_two_pass_z(daily_lines(spark, sf))


@query("window_two_pass_z_events", i=BOUNDS, sql=two_pass_sql(DAILY_E))
def _(spark, sf):
    return WI.window_two_pass_z(daily_events(spark, sf))


@query("window_30d_p75", i=BOUNDS, sql=O.with_("""SELECT account_id, min(day_no) FILTER (v >= p) AS start_day, max(day_no) FILTER (v >= p) AS end_day FROM inside GROUP BY account_id""",
    DAILY_L, totals(5), best("b30", 30), "inside AS (SELECT base.account_id, day_no, v, quantile_cont(v, 0.75) OVER (PARTITION BY base.account_id) AS p FROM base JOIN b30 USING (account_id) WHERE day_no BETWEEN s AND e)"))
def _(spark, sf):
    return WI.window_30d_p75(daily_lines(spark, sf))


@query("window_cdf", i=BOUNDS, sql=O.with_(f"SELECT account_id, {qday(10)} AS start_day, {qday(90)} AS end_day FROM cum_t GROUP BY account_id", DAILY_L, totals(3), cdf("base")))
def _(spark, sf):
    return WI.window_cdf(daily_lines(spark, sf))


def adaptive_sql(daily: str) -> str:
    days = ", ".join(f"{qday(p)} AS d{p}" for p in (5, 8, 10, 20, 80, 90, 92, 95))
    core = "CASE WHEN d80 > d20 THEN d80 - d20 ELSE 1 END"
    pick = lambda a, b, c: f"CASE WHEN {core} <= 30 THEN {a} WHEN span < 90 THEN {b} ELSE {c} END"
    return O.with_(
        "SELECT account_id, CASE WHEN e - s > 180 AND 2 * coalesce(bv, 0) > cv THEN bs ELSE s END AS start_day, CASE WHEN e - s > 180 AND 2 * coalesce(bv, 0) > cv THEN be ELSE e END AS end_day FROM bounds JOIN vols USING (account_id) LEFT JOIN slid USING (account_id)",
        daily, totals(3), cdf("base"),
        f"q AS (SELECT account_id, any_value(last_day - first_day) AS span, {days} FROM cum_t GROUP BY account_id)",
        f"bounds AS (SELECT account_id, {pick('d5', 'd8', 'd10')} AS s, {pick('d95', 'd92', 'd90')} AS e FROM q)",
        "inside AS (SELECT base.account_id, day_no, v, s, e FROM base JOIN bounds USING (account_id) WHERE day_no BETWEEN s AND e)",
        "vols AS (SELECT account_id, sum(v) AS cv FROM inside GROUP BY account_id)",
        """slid AS (SELECT account_id, wv AS bv, day_no AS bs, we AS be FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY wv DESC, day_no) AS rn FROM (
             SELECT account_id, day_no, e, sum(v) OVER r AS wv, max(day_no) OVER r AS we FROM inside WINDOW r AS (PARTITION BY account_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING)) WHERE day_no < e) WHERE rn = 1)""",
    )


@query("window_adaptive_cdf", i=BOUNDS, sql=adaptive_sql(DAILY_L))
def _(spark, sf):
    return WI.window_adaptive_cdf(daily_lines(spark, sf))


@query("window_adaptive_cdf_short", i=BOUNDS, sql=adaptive_sql(DAILY_SHORT))
def _(spark, sf):
    return WI.window_adaptive_cdf(daily_short(spark, sf))


def tight_sql(daily: str) -> str:
    days = ", ".join(f"{qday(p)} AS d{p}" for p in (5, 8, 10, 12, 15, 85, 88, 90, 92, 95))
    pick = lambda a, b, c, d: f"CASE WHEN d90 - d10 + 1 <= 60 THEN {a} WHEN span <= 120 THEN {b} WHEN span <= 365 THEN {c} ELSE {d} END"
    return O.with_(
        """SELECT account_id, CASE WHEN e - s + 1 > 400 THEN CASE WHEN hi = e THEN greatest(s, hi - 400) ELSE lo END ELSE s END AS start_day, CASE WHEN e - s + 1 > 400 THEN hi ELSE e END AS end_day
           FROM (SELECT *, least(e, lo + 400) AS hi FROM (SELECT *, greatest(s, peak - 200) AS lo FROM peaks))""",
        daily, totals(3), cdf("base"),
        f"q AS (SELECT account_id, any_value(last_day - first_day + 1) AS span, {days} FROM cum_t GROUP BY account_id)",
        f"bounds AS (SELECT account_id, {pick('d5', 'd8', 'd12', 'd15')} AS s0, {pick('d95', 'd92', 'd88', 'd85')} AS e0 FROM q)",
        "inside AS (SELECT base.account_id, day_no, v, n, s0, e0 FROM base JOIN bounds USING (account_id) WHERE day_no BETWEEN s0 AND e0)",
        best("b90", 90, "inside"),
        "vols AS (SELECT account_id, sum(v) AS cv FROM inside GROUP BY account_id)",
        """ref AS (SELECT account_id, CASE WHEN e0 - s0 + 1 > 300 AND 100 * vol >= 55 * cv THEN s ELSE s0 END AS s, CASE WHEN e0 - s0 + 1 > 300 AND 100 * vol >= 55 * cv THEN e ELSE e0 END AS e
           FROM bounds JOIN vols USING (account_id) JOIN b90 USING (account_id))""",
        """peaks AS (SELECT account_id, ref.s, ref.e, day_no AS peak FROM (SELECT base.account_id, day_no, row_number() OVER (PARTITION BY base.account_id ORDER BY n DESC, day_no) AS rn FROM base JOIN ref USING (account_id) WHERE day_no BETWEEN s AND e) JOIN ref USING (account_id) WHERE rn = 1)""",
    )


@query("window_tight_v6", i=BOUNDS, sql=tight_sql(DAILY_L))
def _(spark, sf):
    return WI.window_tight_v6(daily_lines(spark, sf))


@query("window_tight_v6_short", i=BOUNDS, sql=tight_sql(DAILY_SHORT))
def _(spark, sf):
    return WI.window_tight_v6(daily_short(spark, sf))


MULTI = dict(i="account_id start_day end_day scale_days n_days", d="coverage")


@query("window_multiscale", **MULTI, sql=multiscale(DAILY_L, (365, 720, 1440), 50, (5, 95), 3, 6))
def _(spark, sf):
    return WI.window_multiscale(daily_lines(spark, sf), (365, 720, 1440))


@query("window_multiscale_events", **MULTI, sql=multiscale(DAILY_E, (14, 30, 60, 90), 50, (5, 95), 3, 6))
def _(spark, sf):
    return WI.window_multiscale(daily_events(spark, sf))


@query("window_v9", **MULTI, sql=multiscale(DAILY_SHORT, (7, 14, 30, 60, 90, 180), 60, (10, 90), 2, 4, 90, True))
def _(spark, sf):
    return WI.window_v9(daily_short(spark, sf))


def smoothed_sql(daily: str) -> str:
    scales = (7, 14, 30, 60, 90, 180, 365)
    pick = lambda c: "CASE " + " ".join(f"WHEN 100 * b{w}.vol >= 55 * st THEN b{w}.{c}" for w in scales) + f" ELSE b90.{c} END"
    joins = " ".join(f"JOIN b{w} USING (account_id)" for w in scales)
    cut = f"count(*) FILTER (v > 0) >= 8 AND any_value(ce - cs) > 30 AND {qday(85)} - {qday(15)} >= 7"
    return O.with_(
        f"SELECT account_id, CASE WHEN {cut} THEN {qday(15)} ELSE any_value(cs) END - 3 AS start_day, CASE WHEN {cut} THEN {qday(85)} ELSE any_value(ce) END + 3 AS end_day FROM cum_t GROUP BY account_id",
        daily, totals(2),
        "cal AS (SELECT account_id, unnest(generate_series(min(day_no), max(day_no))) AS day_no FROM base GROUP BY account_id)",
        "dense AS (SELECT account_id, day_no, coalesce(v, 0) AS v FROM cal LEFT JOIN base USING (account_id, day_no))",
        "sm AS (SELECT *, CAST(sum(v) OVER f * 60 // count(*) OVER f AS BIGINT) AS smooth FROM dense WINDOW f AS (PARTITION BY account_id ORDER BY day_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))",
        *[best(f"b{w}", w, "sm", "smooth") for w in scales],
        "st_t AS (SELECT account_id, sum(smooth) AS st FROM sm GROUP BY account_id)",
        f"chosen AS (SELECT account_id, {pick('s')} AS cs, {pick('e')} AS ce FROM st_t {joins})",
        "inside AS (SELECT sm.account_id, day_no, v, cs, ce FROM sm JOIN chosen USING (account_id) WHERE day_no BETWEEN cs AND ce)",
        cdf("inside"),
    )


@query("window_smoothed_v10", i=BOUNDS, sql=smoothed_sql(DAILY_E))
def _(spark, sf):
    return WI.window_smoothed_v10(daily_events(spark, sf))


@query("window_smoothed_v10_short", i=BOUNDS, sql=smoothed_sql(DAILY_SHORT))
def _(spark, sf):
    return WI.window_smoothed_v10(daily_short(spark, sf))


def core_sql(daily: str) -> str:
    return O.with_(
        "SELECT account_id, min(day_no) AS start_day, max(day_no) AS end_day FROM m3 WHERE nm < 4 OR ((lb IS NULL OR day_no > lb) AND (rb IS NULL OR day_no < rb)) GROUP BY account_id",
        daily, totals(2),
        "sc AS (SELECT account_id, day_no, CAST(round(v * sqrt(n)) AS BIGINT) AS sc FROM base)",
        best("o30", 30, "sc", "sc"),
        "m AS (SELECT sc.account_id, day_no, sc.sc AS sc FROM sc JOIN o30 USING (account_id) WHERE day_no BETWEEN s AND e)",
        best("i7", 7, "m", "sc"),
        "m2 AS (SELECT m.*, s, e, count(*) OVER p AS nm, sum(m.sc) FILTER (day_no BETWEEN s AND e) OVER p AS cs, count(*) FILTER (day_no BETWEEN s AND e) OVER p AS cn FROM m JOIN i7 USING (account_id) WINDOW p AS (PARTITION BY m.account_id))",
        "m3 AS (SELECT *, max(day_no) FILTER (day_no < s AND 4 * sc * cn < cs) OVER p AS lb, min(day_no) FILTER (day_no > e AND 4 * sc * cn < cs) OVER p AS rb FROM m2 WINDOW p AS (PARTITION BY account_id))",
    )


@query("window_core_expand_v11", i=BOUNDS, sql=core_sql(DAILY_E))
def _(spark, sf):
    return WI.window_core_expand_v11(daily_events(spark, sf))


@query("window_core_expand_v11_short", i=BOUNDS, sql=core_sql(DAILY_SHORT))
def _(spark, sf):
    return WI.window_core_expand_v11(daily_short(spark, sf))


D7 = multiscale(DAILY_L, (365, 720, 1440), 50, (5, 95), 3, 6)
FREEZE = "datediff('day', DATE '1970-01-01', freeze_date)"


@query("window_freeze_anchor", i=BOUNDS, sql=O.with_(f"SELECT w.account_id, start_day, greatest(end_day, coalesce({FREEZE}, end_day)) AS end_day FROM w LEFT JOIN accounts USING (account_id)", f"w AS ({D7})", O.ACCOUNTS))
def _(spark, sf):
    return WI.window_freeze_anchor(WI.window_multiscale(daily_lines(spark, sf), (365, 720, 1440)), AD.accounts(spark, sf))


@query("window_freeze_truncate", i=BOUNDS, sql=O.with_(f"SELECT w.account_id, start_day, CASE WHEN {FREEZE} BETWEEN start_day AND end_day THEN {FREEZE} ELSE end_day END AS end_day FROM w LEFT JOIN accounts USING (account_id)", f"w AS ({D7})", O.ACCOUNTS))
def _(spark, sf):
    return WI.window_freeze_anchor(WI.window_multiscale(daily_lines(spark, sf), (365, 720, 1440)), AD.accounts(spark, sf), mode="truncate")


@query("gated_windows", i=BOUNDS, sql=O.with_(f"SELECT account_id, {qday(10)} AS start_day, {qday(90)} AS end_day FROM cum_t GROUP BY account_id", DAILY_L, O.SCORES,
    totals(3, source="(SELECT daily.* FROM daily JOIN scores USING (account_id) WHERE score > 0.4 * 0.8)"), cdf("base")))
def _(spark, sf):
    ids = WI.gate(AD.scores(spark, sf), 0.8, 0.4)
    return WI.window_cdf(AC.daily_series(AD.lineitem_ledger(spark, sf), ids))


WIDTHS = """SELECT count(*) AS n_windows, avg(w) AS mean_width, count(*) FILTER (w < 30) AS lt_30, count(*) FILTER (w < 60) AS lt_60, count(*) FILTER (w < 90) AS lt_90, count(*) FILTER (w > 180) AS gt_180,
  quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.75) AS p75, quantile_cont(w, 0.9) AS p90 FROM (SELECT CAST(end_day - start_day AS DOUBLE) AS w FROM win)"""


@query("window_widths", i="n_windows lt_30 lt_60 lt_90 gt_180", d="mean_width p25 p50 p75 p90", sql=O.with_(WIDTHS, f"win AS ({D7})"))
def _(spark, sf):
    return WI.window_widths(WI.window_multiscale(daily_lines(spark, sf), (365, 720, 1440)))


@query("flag_to_open_stats", d="median_flag_to_open", sql=O.with_("SELECT quantile_cont(datediff('day', opening_date, last_kyc_date), 0.5) AS median_flag_to_open FROM accounts JOIN labels_t USING (account_id) WHERE is_mule = 1", O.ACCOUNTS, O.LABELS))
def _(spark, sf):
    acc = AD.accounts(spark, sf)
    flagged = AD.labels(spark, sf).join(acc.select(A, F.col("last_kyc_date").alias("mule_flag_date")), A)
    return WI.flag_to_open_stats(flagged, acc)


@query("temporal_iou", i="account_id", d="iou", sql=O.with_("""
  SELECT account_id, CASE WHEN p.start_day IS NULL OR t.start_day IS NULL THEN 0 ELSE greatest(0, least(p.end_day, t.end_day) - greatest(p.start_day, t.start_day) + 1)
    / (p.end_day - p.start_day + 1 + t.end_day - t.start_day + 1 - greatest(0, least(p.end_day, t.end_day) - greatest(p.start_day, t.start_day) + 1)) END AS iou FROM p FULL JOIN t USING (account_id)""",
    f"p AS ({D7})", "t AS (" + O.with_(f"SELECT account_id, {qday(10)} AS start_day, {qday(90)} AS end_day FROM cum_t GROUP BY account_id", DAILY_L, totals(3), cdf("base")) + ")"))
def _(spark, sf):
    daily = daily_lines(spark, sf)
    return WI.temporal_iou(WI.window_multiscale(daily, (365, 720, 1440)), WI.window_cdf(daily))
