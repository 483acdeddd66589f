"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_rows import pairs

from ledgersignal.llm import permuterm, queries

SMALL = {c: c + 32 for c in range(65, 91)}


def words_in(docs, shortest=6, often=5):
    counts = Counter()
    for doc_id, text in pairs(docs):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= often}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("spelled", [64, 3])
def test_variants_of_random_words(spark, monkeypatch, spelled):
    monkeypatch.setattr(permuterm, "SPELLED", spelled)
    rng = random.Random(4)
    counts = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))): rng.choice([5, 5, 7, 25, 130, 700, 10**5, 10**12]) for _ in range(500)}
    counts |= {"ab" * 40: 5, "ab" * 40 + "a": 30, "ab" * 20 + "b" + "ab" * 20: 200, "c" * 65: 9, "c" * 64: 45, "c" * 66: 45}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows(permuterm.group_variants(words)) == expected(counts)


def test_chains_are_followed_to_the_end(spark):
    chain = {"a" * (6 + i): 5**i for i in range(1, 20)}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert rows(permuterm.group_variants(words)) == expected(chain)


def test_variants_of_documents(spark, tricky, monkeypatch):
    monkeypatch.setattr(permuterm, "PIECE_BYTES", 50)
    monkeypatch.setattr(permuterm, "HELD_BYTES", 3_000)
    texts = ["Éclairage éclairag ÉCLAIRAGE ×÷×÷×÷ aaaaaaĀbbbbbb ſſſſſſ \x00straßen STRASSEN straßen", None, "", "K" * 500, "K" * 499]
    more = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts * 40)], "doc_id long, text string")
    docs = tricky.select("doc_id", "text").union(more)
    want = expected(words_in(docs))
    assert len(want) > 100
    assert rows(permuterm.spelling_variants(docs)) == want


def test_long_words_take_room_in_proportion():
    assert sum(len(e) for e, _, _ in permuterm.entries("ab" * 20_000)) < 40_000 * 2 * 100


def test_nothing(nothing):
    assert permuterm.spelling_variants(nothing).collect() == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == expected(words_in(spark.read.parquet(f"{sf}/documents.parquet")))
