"""Packing token ids into sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_rows import pairs
from tokenizers import Tokenizer

from ledgersignal.llm import packing, queries

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(counts, capacity):
    """Sequences that piece-by-piece best fit by decreasing length opens."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            room = min(fitting) if fitting else capacity
            if fitting:
                rooms.remove(room)
            rooms.append(room - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 32, 100])
    counts = {n: rng.choice([1, 2, 5, 40]) for n in range(1, capacity + 1) if rng.random() < 0.5}
    slots = packing.plan(counts, capacity)
    filled = defaultdict(list)
    for s in slots:
        for i in range(s.n):
            filled[s.sequence + i // s.per].append((s.offset + i % s.per * s.length, s.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(filled) == best_fit(counts, capacity)
    for n, count in counts.items():
        assert sorted(r for s in slots if s.length == n for r in range(s.rank, s.rank + s.n)) == list(range(count))


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    few, many = packing.plan(counts), packing.plan({n: c * 10**9 + rng.randint(0, 9) for n, c in counts.items()})
    assert max(len(few), len(many)) < 30_000
    with pytest.raises(ValueError):
        packing.plan({0: 1})


def expected_pieces(docs, capacity=1024):
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for doc_id, text in pairs(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        for piece, a in enumerate([0, *range(first, len(ids), capacity)]):
            b = first if piece == 0 else a + capacity
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


ODD = ["<|endoftext|> a<|endoftext|>", "a" * 30_000, " \t\n  x  ", "'ll I'LL  don't", "é́‍😀 的的 \x00", "١٢٣ ⅷ x²", "﻿  end "]


def test_pieces_are_those_of_the_tokenizer(spark, tricky):
    docs = tricky.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = packing.cut(docs, FILE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got) == expected_pieces(docs)


def check_places(rows, capacity=1024):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


def test_places(spark, tricky):
    docs = tricky.unionByName(spark.createDataFrame([(None, "", *[None] * 15)] * 9_000, tricky.schema))
    pieces = packing.cut(docs, FILE)
    got = packing.place(pieces.drop("ids").withColumn("size", pieces["length"])).collect()
    want = Counter()
    for (doc_id, piece, start, length, _), n in expected_pieces(docs).items():
        want[doc_id, piece, start, length] += n
    assert Counter((r.doc_id, r.piece, r.start, r["length"]) for r in got) == want
    assert check_places(got) == best_fit(Counter(r["length"] for r in got), 1024)


def test_sequences_hold_the_ids(tricky):
    packed = packing.pack_documents(tricky, FILE, 64)
    rows = packed.collect()
    check_places(rows, 64)
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert made[r.sequence_id][4 * r.offset : 4 * (r.offset + r["length"])] == bytes(r.ids)


def test_no_documents(nothing):
    assert packing.pack_documents(nothing, FILE).collect() == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_best_fit_packing"](spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == expected_pieces(spark.read.parquet(f"{sf}/documents.parquet"))
    used = check_places(rows)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1
