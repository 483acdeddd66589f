from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry
import corpus_pipeline
from ledgersignal.llm import chosen_path, diagonals, toxicity

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{number}")
        out.append(spark.read.parquet(f"{folder}/{number}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].columns == [*stages[0].columns, "shard"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_rejections(spark, stages):
    labels, bench = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark")]
    scores = toxicity.score_documents(stages[0], labels).filter("predicted = 0")
    assert ids(stages[1]) == ids(scores)
    classes = {r.class_id for r in chosen_path.join_documents(stages[1]).collect()}
    assert ids(stages[2]) == sorted(classes)
    assert ids(stages[3]) == ids(diagonals.find_items(stages[2], bench).filter("n_items = 0"))
    items = [r.text for r in bench.collect()]
    assert not any(i in r.text for r in stages[3].collect() for i in items)


def test_mix_and_shards(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3])) and ids(stages[5]) == ids(stages[4])
    assert {r.shard for r in stages[5].collect()} <= set(range(16))


def test_registered_query_gives_the_stages_rows(spark, stages):
    assert ids(entry.queries()["pipeline"](spark, SF)) == ids(stages[5])


def test_clashing_columns_pass_through(spark, tricky, nothing):
    for docs in (tricky, nothing):
        got = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, SF)
            assert got.columns == docs.columns
            assert got.count() <= 3 * docs.count()
