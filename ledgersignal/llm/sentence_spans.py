"""Substring deduplication by sliding sentence spans.

Runs of several consecutive sentences, or of one long sentence, are hashed and joined over all documents.
Sentences covered by a run that is not the first of its kind are removed: first is the run in the document
with the lowest id, and within a document the one that begins first. Of all runs only the shortest from every
sentence and up to every sentence are hashed, which removes the same sentences.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import small_batches, whole_text
from ledgersignal.session import cut_lineage

#: A run has at least so many sentences and so many words, or is long in words, be it one sentence.
SENTENCES, WORDS, LONG = 2, 25, 25
#: It has at least so many different words, or so many words that it counts whatever they are.
DIFFERENT, ANY = 14, 50
SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…]+(?![\s\"'”»)\]])[^.!?…\n]*)*(?:[.!?…]+[\"'”»)\]]*|\n|$)\s*")
NO_ID = 2**63 - 1  # rows without id come after all others

Run = tuple[int, int, bytes]  # first sentence, one after the last, digest


def sentence_bounds(text: str) -> list[int]:
    """Where sentences begin, and the end of the text. White space belongs to the sentence before."""
    bounds = [m.start() for m in SENTENCE.finditer(text) if m.end() > m.start()]
    return [*bounds, len(text)] if bounds else [0]


def runs_of(text: str, bounds: list[int], sentences: int = SENTENCES, words: int = WORDS, long: int = LONG) -> list[Run]:
    """The shortest runs that are long enough, from every sentence and up to every sentence, in order.

    White space does not count. A run that holds a run that is enough is enough as well, so what any longer run
    covers is covered by the runs of these that lie in it.
    """
    parts = [text[a:b].split() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    joined = [" ".join(p).encode("utf-8", "replace") for p in parts]
    totals = [0, *accumulate(map(len, parts))]
    different = [set(p) for p in parts]
    sizes = [len(d) for d in different]
    n = len(parts)

    def various(start: int, end: int) -> bool:
        if totals[end] - totals[start] >= ANY or max(sizes[start:end], default=0) >= DIFFERENT:
            return True
        return sum(sizes[start:end]) >= DIFFERENT and len(set().union(*different[start:end])) >= DIFFERENT

    runs = set()
    for start in range(n):  # from every sentence: the first end with enough words, and on until they differ
        end = min(bisect_left(totals, totals[start] + long), max(start + sentences, bisect_left(totals, totals[start] + words)))
        while end <= n and not various(start, end):
            end += 1
        if end > n:
            break
        runs.add((start, end))
    for end in range(n, 0, -1):  # up to every sentence
        start = max(bisect_right(totals, totals[end] - long), min(end - sentences + 1, bisect_right(totals, totals[end] - words))) - 1
        while start >= 0 and not various(start, end):
            start -= 1
        if start < 0:
            break
        runs.add((start, end))
    return [(a, b, hashlib.blake2b(b"\n".join(joined[a:b]), digest_size=16).digest()) for a, b in sorted(runs)]


def _keys() -> list[Column]:
    """Document number, a mark that tells texts with the same id apart, and the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(whole_text()).alias("mark"),
        whole_text().alias("text"),
    ]


def all_runs(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long: int = LONG) -> DataFrame:
    """Runs of all documents: (a, b) digest, document, sentences covered, and whether the text had it before."""

    def table(docs: list[int], marks: list[int], counts: list[int], runs: list[Run], again: list[bool]) -> pd.DataFrame:
        starts, ends, digests = zip(*runs, strict=True) if runs else ((), (), ())
        halves = np.array(digests, "V16").view(">i8").astype(np.int64).reshape(-1, 2)
        places = {"start": np.array(starts, np.int32), "end": np.array(ends, np.int32), "again": np.array(again, bool)}
        return pd.DataFrame({"a": halves[:, 0], "b": halves[:, 1], "doc": np.repeat(np.array(docs, np.int64), counts), "mark": np.repeat(np.array(marks, np.int64), counts), **places})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, marks, counts, found, again = [], [], [], [], []
            for doc, mark, text in zip(batch["doc"], batch["mark"], batch["text"], strict=True):
                runs, seen = runs_of(text, sentence_bounds(text), sentences, words, long), set()
                texts.append(doc)
                marks.append(mark)
                counts.append(len(runs))
                found += runs
                for _, _, digest in runs:
                    again.append(digest in seen)
                    seen.add(digest)
                if len(found) > 100_000:
                    yield table(texts, marks, counts, found, again)
                    texts, marks, counts, found, again = [], [], [], [], []
            yield table(texts, marks, counts, found, again)

    return docs.select(*_keys()).mapInPandas(find, "a long, b long, doc long, mark long, start int, end int, again boolean")


def dedup_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed, words_removed, and the text that stays.

    Null texts are empty. Texts too short for a run stay whole, copies included. Rows with the same id count
    as one document: a run they share is kept in each of them, once. Rows without id come last, as one
    document. Other columns are not read; an empty table gives no rows.

    Digests are counted with partial sums; those that occur once end there. The join that takes the others
    back to their documents has a shuffle on both sides, so Spark splits the rows of a very common run.
    """
    runs = all_runs(small_batches(docs), sentences, words, long)
    repeated = cut_lineage(runs.groupBy("a", "b").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "first"))
    later = runs.join(repeated, ["a", "b"]).filter(F.col("again") | (F.col("doc") > F.col("first")))
    spans = later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # at most two per sentence of a text
    keyed = docs.select("doc_id", *_keys()).join(spans, ["doc", "mark"], "left")

    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, covered in zip(text, spans, strict=True):
            bounds = sentence_bounds(t)
            gone = set()
            for s in covered if covered is not None else ():
                gone.update(range(s["start"], s["end"]))
            pieces = [t[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows.append((len(pieces), len(gone), sum(len(pieces[i].split()) for i in gone), "".join(p for i, p in enumerate(pieces) if i not in gone)))
        return pd.DataFrame(rows, columns=["n_sentences", "n_removed", "words_removed", "text"])

    cut_udf = F.pandas_udf(cut, "n_sentences long, n_removed long, words_removed long, text string")
    return keyed.select("doc_id", cut_udf("text", "spans").alias("cut")).select("doc_id", "cut.*")
