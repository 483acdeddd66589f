"""Sharding and mixing."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_rows import pairs

from ledgersignal.llm import curriculum, hash_tree


def test_shards(tricky):
    got = hash_tree.shard_documents(tricky).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(tricky)
    )
    slots = defaultdict(list)
    of_id = defaultdict(set)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
        of_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_id.values())


def test_empty(nothing):
    assert hash_tree.shard_documents(nothing).collect() == []
    assert curriculum.mix(nothing).collect() == []
    assert curriculum.take(nothing).collect() == []


def test_weights_and_confined_moves(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    key = ids["doc_id"].cast("string")
    light = hash_tree.balanced_tree(16)
    heavy = hash_tree.balanced_tree(16, {5: 3.0})
    both = hash_tree.assign(hash_tree.assign(ids, key, light, "a_"), key, heavy, "b_")
    moved = both.filter("a_shard <> b_shard").groupBy("a_region", "b_region", "a_shard", "b_shard").count().collect()
    # Shard 5 lies in rack 1 of region 0. Documents only come into subtrees that grew: region 0, rack 1, shard 5.
    assert all(m.a_region == m.b_region == 0 and m.b_shard in range(4, 8) or (m.a_region, m.b_region) == (1, 0) for m in moved)
    assert {m.b_shard for m in moved if m.a_shard in range(4, 8)} == {5}
    sizes = {r.b_shard: r["count"] for r in both.groupBy("b_shard").count().collect()}
    assert sizes[5] == pytest.approx(40_000 * 3 / 18, rel=0.1)
    assert min(n for s, n in sizes.items() if s != 5) > 0.85 * 40_000 / 18
    more = hash_tree.assign(hash_tree.assign(ids, key, light, "a_"), key, hash_tree.grown(light), "b_")
    into = {r.b_shard: r["count"] for r in more.filter("a_shard <> b_shard").groupBy("b_shard").count().collect()}
    assert set(into) == {16} and into[16] == pytest.approx(40_000 / 17, rel=0.1)


@pytest.mark.parametrize(("base", "most"), [(1, 40), (16, 40), (5, 12)])
def test_every_further_shard_takes_rows_into_itself(spark, base, most):
    ids = spark.range(6_000).withColumnRenamed("id", "doc_id")
    key = ids["doc_id"].cast("string")
    trees = [hash_tree.tree_of(n, base) for n in range(base, most + 1)]
    assert all(hash_tree.grown(a) == b for a, b in zip(trees[:-1], trees[1:], strict=True))
    before = None
    for n, tree in enumerate(trees, base):
        shard_of = {r.doc_id: r.shard for r in hash_tree.assign(ids, key, tree).select("doc_id", "shard").collect()}
        assert set(shard_of.values()) == set(range(n))
        assert before is None or all(shard_of[i] in (s, n - 1) for i, s in before.items())
        before = shard_of


def test_grown_shard_is_the_next_run(tricky):
    for n in (3, 16, 17, 20):
        now = {r.doc_id: r.grown_shard for r in hash_tree.shard_documents(tricky, n).collect()}
        assert now == {r.doc_id: r.shard for r in hash_tree.shard_documents(tricky, n + 1).collect()}


def test_place_keeps_columns(tricky):
    spread = hash_tree.place(tricky.drop("shard"))
    assert spread.columns == [*tricky.drop("shard").columns, "shard"] and spread.count() == tricky.count()


def test_mix(tricky):
    got = curriculum.mix(tricky).collect()
    source = {}
    sizes = defaultdict(int)
    rows = []
    for r in tricky.select("doc_id", "text", "source").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        rows.append((r.doc_id, n, r.source))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_, left = set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target.update({s: level * weight[s] for s in open_})
    for i, n, s in rows:
        source.setdefault((i, n), set()).add((sizes[s], round(target[s], 6)))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for i, n, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert (r.source_size, round(r.target, 6)) in source[r.doc_id, r.size]
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == -(-r.taken // r.size if r.size else 0)
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source_size, round(r.target, 6)] += r.taken
    alike = Counter((sizes[s], round(target[s], 6)) for s in order)
    assert all(abs(t * alike[n, t] - words) <= alike[n, t] for (n, t), words in taken.items())
    assert sorted(map(str, curriculum.mix(tricky.repartition(5)).collect())) == sorted(map(str, got))


def test_positions_follow_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s" + str(i % 2)) for i in range(2000)], "doc_id long, text string, source string")
    got = curriculum.passes(curriculum.mix(docs, weights=(1.0, 1.0), tilts=(0.8, -0.8))).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    half = Counter((r.doc_id % 2, r.position < 0.5) for r in got)
    # The first half of a schedule 1 + tilt (2t - 1) has a share of 1/2 - tilt/4.
    assert half[0, True] == pytest.approx(0.3 * 1000, abs=2) and half[1, True] == pytest.approx(0.7 * 1000, abs=2)


def test_take(tricky):
    taken = curriculum.take(tricky)
    assert taken.columns == tricky.columns
    want = Counter()
    for r in curriculum.mix(tricky).collect():
        if r.size:
            want[r.doc_id] += round(r.taken / r.size)
    got = Counter(r.doc_id for r in taken.collect())
    once = {i for i, n in Counter(i for i, _ in pairs(tricky)).items() if n == 1}
    assert {i: n for i, n in got.items() if i in once} == {i: n for i, n in want.items() if i in once and n}
