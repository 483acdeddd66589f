from __future__ import annotations

import random
import zlib

import pytest

from ledgersignal.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    return toxicity.score_documents(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert scored.score.between(0, 1).all()
    assert ((scored.score >= 0.7) == (scored.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    known = scored[scored.held_out & scored.toxic.notna()]
    bad, good = known[known.toxic == 1], known[known.toxic == 0]
    # Some marks of these tables lie on texts that differ in nothing from clean ones.
    assert (bad.predicted == 1).mean() > 0.82 and (good.predicted == 1).mean() < 0.01
    ranks = known.score.rank()
    auc = (ranks[known.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.94


def test_features():
    learned = {"gruff": 3.0, "vile~": 4.0}
    get = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, learned), strict=True))
    assert all(v == 0 for v in get("").values())
    f = get("you are an IDIOT!! and vileness")
    assert f["insult_density"] == 1 / 6 and f["learned_top"] == 4.0 and f["learned_density"] == 2 / 6
    assert f["near_you"] == 1 / 6 and f["shout_rate"] == 1 / 6 and f["mark_rate"] > 0 and f["run_rate"] > 0
    g = get("such an 1di0t and an i.d.i.o.t")
    assert g["obfuscated_rate"] > 0 and g["deobfuscated_density"] > 0


def small(spark, with_labels):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" grumblor grumblat" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (400, ""), (400, "")], "doc_id long, text string")
    marks = [(i, int(i % 4 == 0)) for i in range(300)] if with_labels else []
    labels = spark.createDataFrame([*marks, (None, 1), (7, None), (8, 1)], "doc_id long, toxic int")
    return docs, labels


def test_terms_are_learned(spark):
    docs, labels = small(spark, True)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 403
    unseen = [r for r in got if r.doc_id is not None and r.doc_id >= 300 and r.doc_id < 400]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in unseen)
    assert len({r.score for r in got if r.doc_id in (None, 400)}) == 1


def test_without_labels_the_fixed_lexicon_decides(spark, tricky, nothing):
    docs, labels = small(spark, False)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 403 and all(r.score == 0 for r in got)
    insults = spark.createDataFrame([(1, "you stupid idiot")], "doc_id long, text string")
    assert toxicity.score_documents(insults, labels).first().predicted == 1
    assert toxicity.score_documents(nothing, labels).collect() == []
    assert toxicity.keep_civil(nothing, labels).collect() == []
    kept = toxicity.keep_civil(tricky, labels)
    assert kept.columns == tricky.columns and kept.count() == tricky.count()
