"""Ranked lexical search against scores of all pairs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from check_oracle import compare
from conftest_rows import pairs

from ledgersignal.llm import norm_buckets, queries

SMALL = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(SMALL) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def expected(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    want = Counter()
    for item_id, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c in docs:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in asked.items() if c[t]
            )
            scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            if score < 0:
                want[item_id, rank, i, -score] += 1
    return want


def got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def items_of(docs):
    texts = [t for _, t in docs if t]
    items = [(i, t[:200]) for i, t in enumerate(texts)] + [(1000, None), (1001, " !"), (1002, "onlyhere"), (1003, "one ONE two"), (None, texts[0]), (3, texts[5])]
    return items + [(1004, texts[7] + " " + texts[9]), (1005, "clash 的 A\x00B x")]


@pytest.mark.parametrize(("ratio", "coordinates", "block"), [(1.2, 200_000, 2_000), (1.05, 30, 3), (3.0, 500, 7)])
def test_all_pairs(spark, tricky, monkeypatch, ratio, coordinates, block):
    for name, value in (("RATIO", ratio), ("BLOCK_COORDINATES", coordinates), ("ITEM_BLOCK", block), ("PIECE_BYTES", 100), ("LEADERS", 2 if block == 3 else 32)):
        monkeypatch.setattr(norm_buckets, name, value)
    docs = pairs(tricky)
    items = items_of(docs)
    table = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    assert got(norm_buckets.rank_documents(tricky, table)) == expected(docs, items)


def test_sieve_keeps_all_terms(spark):
    words = [f"w{i}é" for i in range(5_000)]
    bits = norm_buckets._bits(norm_buckets.term_sieve(spark.createDataFrame([(w,) for w in words], "term string")))
    assert all(bits[norm_buckets._place(w.encode())] for w in words)
    assert bits.sum() <= 5_000


def test_buckets_are_skipped():
    """A block of short vectors gives nothing to an item whose threshold they cannot reach."""
    import pandas as pd

    docs = pd.DataFrame({"row": [1, 2], "doc": [1, 2], "missing": [False, False], "norm": [5.0, 5.0], "ids": [[1, 2], [2, 3]], "values": [[3, 4], [4, 3]]})
    items = pd.DataFrame({"item": [7, 8], "threshold": [100, 1], "ids": [[1, 2], [2]], "counts": [[1, 1], [1]]})
    best = norm_buckets.search_block(docs, items)
    assert set(best["item"]) == {8} and list(best["score"]) == [4, 4]


def test_nothing(spark, tricky, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert norm_buckets.rank_documents(nothing, items).collect() == []
    assert norm_buckets.rank_documents(tricky, items.limit(0)).collect() == []


def test_query_over_the_whole_table(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES["op11_lexical_search"](spark, sf)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert got(df) == expected(pairs(docs), [(r.item_id, r.text) for r in items.collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(df, con, queries.ORACLE_SQL["op11_lexical_search"]) is None
