from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest_rows import pairs
from pyspark.sql import functions as F

from ledgersignal.llm import sketches


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(tricky):
    # Without ties of ids the order of documents is that of the ids alone.
    docs = tricky.filter("doc_id is null or doc_id <> 15")
    rows = pairs(docs)
    distinct = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: -r[0])
    got = [r for r in sketches.fingerprint_documents(docs, k=4000).collect()]
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for (i, t), (_, following) in zip(distinct, distinct[1:], strict=False):
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = by_id[i].sketch, by_id[i].edited_sketch
        # With a large k the sketch holds all shingles, so likeness is exact.
        if len(shingles(t)) < 4000:
            assert len(own) == len(shingles(t)) and len(other) == len(shingles(edited))
            assert likeness(set(own), set(other)) == pytest.approx(likeness(shingles(t), shingles(edited)))
            assert len(by_id[i].next_sketch) == min(4000, len(shingles(following)))
    same = defaultdict(set)
    for r in got:
        if r.doc_id in (7, 8, 16):
            same["passage" if r.doc_id == 16 else "base"].add(tuple(r.sketch))
    assert all(len(s) == 1 for s in same.values())


def test_ties_and_last(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "b"), (1, "cc")], "doc_id long, text string")
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in sketches.fingerprint_documents(docs).collect()}
    first = {hashlib.sha256(("c" + x).encode()).hexdigest() for x in "ab"}
    assert got[1, 2] in first  # the last document takes from the first


def test_single_and_empty(spark, nothing):
    assert sketches.fingerprint_documents(nothing).collect() == []
    alone = sketches.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_estimates_and_merge(spark):
    words = [f"w{i}" for i in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words[:20_000])), (2, " ".join(words[5_000:25_000]))], "doc_id long, text string")
    s = sketches.with_sketch(docs, "text", "sketch", k=512).select("doc_id", "sketch")
    a, b = [s.filter(F.col("doc_id") == i).select(F.col("sketch").alias(f"s{i}")) for i in (1, 2)]
    row = a.crossJoin(b).select(
        sketches.resemblance(F.col("s1"), F.col("s2"), 512), sketches.containment(F.col("s1"), F.col("s2"), 512), sketches.distinct_count(F.col("s1"), 512)
    ).first()
    assert row[0] == pytest.approx(15 / 25, abs=0.09) and row[1] == pytest.approx(0.75, abs=0.12) and row[2] == pytest.approx(19_996, rel=0.2)
    merged = sketches.merge_sketches(s.withColumn("g", F.lit("all")), ["g"], "sketch", 512).first().sketch
    union = {h for r in s.collect() for h in r.sketch}
    assert list(merged) == sorted(union)[:512]
    empty = spark.createDataFrame([(1, "")], "doc_id long, text string")
    none = sketches.merge_sketches(sketches.with_sketch(empty, "text", "sketch"), ["doc_id"], "sketch").first()
    assert none.doc_id == 1 and list(none.sketch) == []
