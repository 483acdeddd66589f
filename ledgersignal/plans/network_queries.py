"""Queries over network features. Users and event counterparties share one id space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgersignal.operators import network as NW
from ledgersignal.plans import oracle_parts as O
from ledgersignal.plans.registry import query
from ledgersignal.sources import adapters as AD

A = "account_id"
W = O.with_
EDGES = "edges AS (SELECT account_id AS src, counterparty_id AS dst, sum(c) / 100 AS total_volume, count(*) AS txn_count FROM ledger WHERE counterparty_id IS NOT NULL GROUP BY ALL)"
UNDIRECTED = """pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(txn_count) AS w FROM edges WHERE src <> dst GROUP BY ALL),
adj AS (SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs)"""
GRAPH = (O.EVENTS, EDGES, UNDIRECTED)


def edges(spark, sf):
    return NW.build_edges(AD.event_ledger(spark, sf))


def line_edges(spark, sf):
    return NW.build_edges(AD.lineitem_ledger(spark, sf))


@query("build_edges", i="src dst txn_count", d="total_volume", sql=W("SELECT * FROM edges", O.LEDGER, EDGES))
def _(spark, sf):
    return line_edges(spark, sf)


@query("build_edges_signed", i="src dst txn_count", d="total_volume", sql=W("SELECT account_id AS src, counterparty_id AS dst, sum(CASE WHEN amount < 0 THEN -c ELSE c END) / 100 AS total_volume, count(*) AS txn_count FROM ledger GROUP BY ALL", O.EVENTS))
def _(spark, sf):
    return NW.build_edges(AD.event_ledger(spark, sf), signed=True)


@query("degree", i="node degree", sql=W("SELECT src AS node, count(DISTINCT dst) AS degree FROM edges GROUP BY src", O.EVENTS, EDGES))
def _(spark, sf):
    return NW.degree(edges(spark, sf))


def _pagerank_sql(rounds, limit=None):
    parts = ["walk AS (SELECT * FROM adj UNION ALL SELECT src, dst, sum(txn_count) AS w FROM edges WHERE src = dst GROUP BY ALL)", "nodes AS (SELECT src AS node, sum(w) AS s FROM walk GROUP BY src)", "r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT nodes.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(got, 0) AS rank FROM nodes LEFT JOIN (SELECT dst AS node, sum(rank / s * w) AS got FROM walk JOIN r{i - 1} ON walk.src = r{i - 1}.node JOIN nodes n2 ON n2.node = walk.src GROUP BY dst) USING (node))")
    value = "1000 * rank AS pagerank_k" if limit is None else f"round({limit} * rank, 4) AS pagerank_m"
    return W(f"SELECT node, {value} FROM r{rounds}", *GRAPH, *parts)


@query("pagerank_10", i="node", d="pagerank_k", sql=_pagerank_sql(10))
def _(spark, sf):
    ranks = NW.pagerank(edges(spark, sf), max_iter=10, tol=None)
    return ranks.select("node", (1000 * F.col("pagerank")).alias("pagerank_k"))


@query("pagerank", i="node", d="pagerank_m", sql=_pagerank_sql(60, 1000))
def _(spark, sf):
    # Run until ranks differ from the limit by less than the compared digits.
    return NW.pagerank(edges(spark, sf), tol=1e-12).select("node", F.round(1000 * F.col("pagerank"), 4).alias("pagerank_m"))


@query("clustering", i="node degree triangles", d="clustering", sql=W("""
  , tri AS (SELECT x.src AS node, count(*) // 2 AS triangles FROM adj x JOIN adj y ON x.src = y.src AND x.dst <> y.dst JOIN adj z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src)
  SELECT node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree >= 2 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering
  FROM (SELECT src AS node, count(*) AS degree FROM adj GROUP BY src) LEFT JOIN tri USING (node)""", *GRAPH))
def _(spark, sf):
    return NW.clustering(edges(spark, sf))


@query("connected_components", i="node component component_size", sql="WITH RECURSIVE " + ", ".join(["ledger AS (SELECT c_custkey AS account_id, c_nationkey + 1000000 AS counterparty_id, 1 AS c FROM customer)", EDGES, UNDIRECTED]) + """,
  reach AS (SELECT src AS node, src AS other FROM adj UNION SELECT reach.node, adj.dst FROM reach JOIN adj ON reach.other = adj.src),
  comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp""")
def _(spark, sf):
    txn = AD.table(spark, sf, "customer").select(F.col("c_custkey").alias(A), (F.col("c_nationkey") + 1000000).cast("bigint").alias("counterparty_id"), F.lit(0.01).alias("amount"))
    return NW.connected_components(NW.build_edges(txn))


def _communities_sql(rounds):
    parts = ["own AS (SELECT src AS node, sum(w) // 2 AS half FROM adj GROUP BY src)", "l0 AS (SELECT node, node AS label FROM own)"]
    for i in range(1, rounds + 1):
        p = f"l{i - 1}"
        parts.append(f"l{i} AS MATERIALIZED (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, label) AS rn FROM (SELECT adj.dst AS node, label, w FROM adj JOIN {p} ON adj.src = {p}.node UNION ALL SELECT {p}.node, label, half FROM {p} JOIN own USING (node)) GROUP BY node, label) WHERE rn = 1)")
    return W(f"SELECT node, label AS community_id, count(*) OVER (PARTITION BY label) AS community_size FROM l{rounds}", *GRAPH, *parts)


# The labels settle within 12 rounds at every size of the tables; more rounds change nothing.
@query("communities", i="node community_id community_size", sql=_communities_sql(12))
def _(spark, sf):
    return NW.communities(edges(spark, sf))


@query("modularity", d="modularity", sql=W("""
  SELECT sum(inside / m2 - (k / m2) * (k / m2)) AS modularity FROM (SELECT x.c_nationkey AS c, sum(w) AS k, sum(CASE WHEN x.c_nationkey = y.c_nationkey THEN w ELSE 0 END) AS inside, any_value((SELECT sum(w) FROM adj)) AS m2
  FROM adj JOIN customer x ON src = x.c_custkey JOIN customer y ON dst = y.c_custkey GROUP BY 1)""", *GRAPH))
def _(spark, sf):
    groups = AD.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community_id"))
    return NW.modularity(edges(spark, sf), groups)


@query("betweenness_sampled", i="node", d="betweenness")
def _(spark, sf):
    return NW.betweenness_sampled(edges(spark, sf))


@query("mule_overlap", i="account_id cp_mule_overlap", d="cp_mule_overlap_ratio", sql=W("""
  SELECT src AS account_id, sum(used) AS cp_mule_overlap, sum(used) / count(*) AS cp_mule_overlap_ratio FROM edges JOIN (SELECT dst, max(is_mule) AS used FROM edges JOIN labels_t ON src = account_id GROUP BY dst) USING (dst) GROUP BY src""", O.EVENTS, O.LABELS, EDGES))
def _(spark, sf):
    return NW.mule_overlap(edges(spark, sf), AD.labels(spark, sf))


@query("shared_network", i="account_id shared_network_size shared_mule_neighbors", sql=W("""
  SELECT x.src AS account_id, count(DISTINCT y.src) - 1 AS shared_network_size, count(DISTINCT CASE WHEN is_mule = 1 AND y.src <> x.src THEN y.src END) AS shared_mule_neighbors
  FROM edges x JOIN edges y USING (dst) JOIN labels_t ON y.src = labels_t.account_id GROUP BY x.src""", O.EVENTS, O.LABELS, EDGES))
def _(spark, sf):
    return NW.shared_network(edges(spark, sf), AD.labels(spark, sf))


@query("mule_exposure", i="account_id cp_mule_count cp_unique_count_graph cp_internal_count", d="cp_mule_rate cp_mule_vol_pct", sql=W("""
  SELECT src AS account_id, coalesce(sum(is_mule), 0) AS cp_mule_count, coalesce(sum(is_mule), 0) / count(*) AS cp_mule_rate, coalesce(sum(total_volume) FILTER (is_mule = 1), 0) / greatest(sum(total_volume), 1) AS cp_mule_vol_pct,
         count(*) AS cp_unique_count_graph, count(labels_t.account_id) AS cp_internal_count FROM edges LEFT JOIN labels_t ON dst = labels_t.account_id GROUP BY src""", O.EVENTS, O.LABELS, EDGES))
def _(spark, sf):
    labels = AD.labels(spark, sf)
    return NW.mule_exposure(edges(spark, sf), labels, labels)


@query("two_hop_exposure", i="account_id cp_2hop_mule_count", sql=W("""
  SELECT x.src AS account_id, coalesce(sum(h.n), 0) AS cp_2hop_mule_count FROM edges x LEFT JOIN (
    SELECT y.src, count(*) AS n FROM edges y JOIN labels_t b ON y.dst = b.account_id AND b.is_mule = 1 JOIN labels_t a ON y.src = a.account_id AND a.is_mule = 1 GROUP BY y.src) h ON x.dst = h.src GROUP BY x.src""", O.EVENTS, O.LABELS, EDGES))
def _(spark, sf):
    return NW.two_hop_exposure(edges(spark, sf), AD.labels(spark, sf))
