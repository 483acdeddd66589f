"""Removal of repeated byte strings by sorted samples of suffixes, after the difference-cover algorithm.

The difference-cover algorithm sorts the suffixes at sampled places by a prefix, names the prefixes, recurses
on the names where they are not yet distinct, places the remaining suffixes by the bytes up to their next
sample and its name, and compares neighbours. A cover by residues (two of three places) would shuffle
two rows for every three bytes of the corpus at each level. The cover here is taken from the content instead:
of every ``GAP`` consecutive places the one whose next ``GRAM`` bytes hash lowest is sampled. It has what the
algorithm needs of a cover, for equal strings of ``LENGTH = GAP + GRAM - 1`` bytes have a sample at the same
distance, and takes about 2 rows for every GAP bytes.

1. Samples are named by their next ``GRAM`` bytes. A name that occurs once has no repeated string.
2. The others get longer names, over all bytes of the strings that have this sample as their first.
   Places with equal longer names repeat as a whole.
3. Where a short name has several longer ones, the remaining suffixes, one for every byte before the sample,
   are compared by their first ``LENGTH`` bytes, once per longer name: each is named by 128 bits, names are
   sorted, and equal neighbours repeat. Up to ``GROUP`` longer names the bytes meet in one task, which sorts
   them; beyond, Spark deals out the names of all suffixes.

Names are 128-bit hashes (64 bits of the short and 64 of the long name); rows with equal names meet by
Spark's shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import Rows, small_batches, stored, walk_groups, whole_text

LENGTH = 200
GRAM = 51
#: Long names of a short name that are compared in one task: some megabytes of strips.
GROUP = 10_000
NO_ID = 2**63 - 1
#: Bytes that are hashed at once; longer texts go in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 18

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD = 1 << 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of all strings of a buffer from running sums of byte codes times powers of an odd number."""

    def __init__(self, size: int):
        rng = np.random.default_rng(20240229)
        self.codes = [rng.integers(1, WORD, 256, dtype=np.uint64, endpoint=False) for _ in MULTIPLIERS]
        self.size, self.powers, self.inverses = 0, [], []
        self.grow(size)

    def grow(self, size: int) -> None:
        if size <= self.size:
            return

        def run(m):
            steps = np.full(size + 1, np.uint64(m))
            steps[0] = 1
            return np.multiply.accumulate(steps)

        self.powers = [run(m) for m in MULTIPLIERS]
        self.inverses = [run(pow(m, -1, WORD)) for m in MULTIPLIERS]
        self.size = size

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        self.grow(len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes[which][data] * self.powers[which][: len(data)], dtype=np.uint64)])

    def strings(self, sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverses[which][start])

    def grams(self, sums: np.ndarray, which: int, size: int) -> np.ndarray:
        n = len(sums) - size
        return _mix((sums[size:] - sums[:n]) * self.inverses[which][:n])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima within blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(WORD - 1))
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def samples(pieces: list[tuple[int, bytes]], hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(piece, low, wide, short name, long name): sampled places with the places low..low+wide they come first for.

    A piece is (place of its first byte in the text, bytes); places in the result are places in the text.
    """
    gap = length - gram + 1
    data = np.frombuffer(b"".join(b for _, b in pieces), np.uint8)
    sizes = np.array([len(b) for _, b in pieces], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if len(data) < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    sums = hasher.sums(data, 0)
    names = hasher.grams(sums, 0, gram)
    bits = np.uint64(24)  # a buffer is below 2**24 bytes; equal hashes keep the leftmost place
    low_mask = np.uint64((1 << 24) - 1)
    first = window_minima((names & ~low_mask) | np.arange(len(names), dtype=np.uint64), gap) & low_mask
    piece = np.repeat(np.arange(len(pieces)), np.maximum(0, sizes - length + 1))
    place = np.arange(len(piece)) - np.repeat(np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1), np.maximum(0, sizes - length + 1)) + begins[piece]
    assert len(data) < 1 << int(bits)
    if not len(place):
        return piece, place, place, place, place
    own = first[place].astype(np.int64)
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])])
    at = np.nonzero(new)[0]
    low = place[at]
    high = np.append(place[at[1:] - 1], place[-1])
    owner = own[at]
    long = hasher.strings(sums, 0, low, high + length) ^ _mix((owner - low).astype(np.uint64) * np.uint64(MULTIPLIERS[1]) + (high - low).astype(np.uint64))
    offset = np.array([o for o, _ in pieces], np.int64) - begins[:-1]
    return piece[at], low + offset[piece[at]], high - low, names[owner].astype(np.int64), long.astype(np.int64)


def _buffers(rows: Iterator[tuple], piece: int, length: int) -> Iterator[tuple[list, list]]:
    """Rows (keys..., text bytes) as buffers of pieces of texts: (keys of each piece, pieces)."""
    keys, pieces, size = [], [], 0
    for *key, data in rows:
        for start in range(0, max(1, len(data) - length + 1), piece):
            part = data[start : start + piece + length - 1]
            if len(part) < length:
                continue
            keys.append(key)
            pieces.append((start, part))
            size += len(part)
            if size >= piece:
                yield keys, pieces
                keys, pieces, size = [], [], 0
    if pieces:
        yield keys, pieces


def _keys(docs: DataFrame) -> list[Column]:
    """Document number, a mark that tells texts with the same id apart, and the bytes of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        (F.crc32(whole_text().cast("binary")) - 2**31).cast("int").alias("mark"),
        whole_text().cast("binary").alias("data"),
    ]


def sample_table(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """Samples of all texts: short name, long name, text, first place and number of further places."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(2 * piece)
        for batch in batches:
            for keys, pieces in _buffers(zip(batch["doc"], batch["mark"], batch["data"], strict=True), piece, length):
                which, low, wide, short, long = samples(pieces, hasher, length, gram)
                doc = np.array([k[0] for k in keys], np.int64)
                mark = np.array([k[1] for k in keys], np.int32)
                yield pd.DataFrame({"short": short, "long": long, "doc": doc[which], "mark": mark[which], "low": low.astype(np.int32), "wide": wide.astype(np.int32)})

    return docs.select(*_keys(docs)).mapInPandas(take, "short long, long long, doc long, mark int, low int, wide int")


def named_places(texts: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """For texts with ``asked`` (first place, further places, whether a single name): the name of each place."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(2 * piece)
        for batch in batches:
            out, size = [], 0
            for doc, mark, data, asked in zip(batch["doc"], batch["mark"], batch["data"], batch["asked"], strict=True):
                low = np.array([a["low"] for a in asked], np.int64)
                many = np.array([a["wide"] for a in asked], np.int64) + 1
                place = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                single = np.repeat(np.array([a["single"] for a in asked]), many)
                bytes_ = np.frombuffer(data, np.uint8)
                for start in range(0, max(1, len(bytes_) - length + 1), piece):
                    here = (place >= start) & (place < start + piece)
                    if not here.any():
                        continue
                    at = place[here] - start
                    part = bytes_[start : start + piece + length - 1]
                    names = [hasher.strings(hasher.sums(part, w), w, at, at + length).astype(np.int64) for w in (0, 1)]
                    out.append(pd.DataFrame({"a": names[0], "b": names[1], "doc": doc, "mark": mark, "place": (at + start).astype(np.int32), "single": single[here]}))
                    size += len(at)
                if size > 200_000:
                    yield pd.concat(out)
                    out, size = [], 0
            if out:
                yield pd.concat(out)

    return texts.mapInPandas(name, "a long, b long, doc long, mark int, place int, single boolean")


def strips(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """For texts with ``asked`` (short name, first place, further places, whether single): the bytes of the places."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["short", "doc", "mark", "low", "single", "strip"]
        for batch in batches:
            rows, size = [], 0
            for doc, mark, data, asked in zip(batch["doc"], batch["mark"], batch["data"], batch["asked"], strict=True):
                for a in asked:
                    strip = data[a["low"] : a["low"] + a["wide"] + length]
                    rows.append((a["short"], doc, mark, a["low"], a["single"], strip))
                    size += len(strip)
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(take, "short long, doc long, mark int, low int, single boolean, strip binary")


def string_names(strips_: list[bytes], hasher: Hasher, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strip, place in it, two hashes) of every string of ``length`` bytes, some strips at a time."""
    out, first, size = [], 0, 0
    for i, strip in enumerate(strips_):
        size += len(strip)
        if size >= PIECE or i == len(strips_) - 1:
            part = strips_[first : i + 1]
            sizes = np.array([len(x) for x in part], np.int64)
            many = sizes - length + 1
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = place + np.repeat(np.cumsum(sizes) - sizes, many)
            data = np.frombuffer(b"".join(part), np.uint8)
            names = [hasher.strings(hasher.sums(data, w), w, at, at + length) for w in (0, 1)]
            out.append((np.repeat(np.arange(first, i + 1), many), place, *names))
            first, size = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_places(length: int):
    hasher = Hasher(2 * PIECE)

    def compare(rows: Rows) -> Rows | None:
        """Runs of places of single strips whose strings another strip of the group has as well."""
        single = rows["single"].astype(bool)
        if not single.any():
            return None
        strip, place, a, b = string_names(list(rows["strip"]), hasher, length)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])  # equal neighbours
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        hit = np.nonzero(again & single[strip])[0]
        if not len(hit):
            return None
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (strip[hit[1:]] != strip[hit[:-1]])])
        begin = hit[new]
        end = hit[np.append(np.nonzero(new)[0][1:] - 1, len(hit) - 1)]
        own = strip[begin]
        return {"doc": rows["doc"][own], "mark": rows["mark"][own], "low": rows["low"][own] + place[begin], "wide": end - begin}

    return compare


def merged_spans(low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by [low, end)."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], low[1:] > end[:-1]])
    at = np.nonzero(new)[0]
    return low[at], np.append(end[at[1:] - 1], end[-1])


def cut(data: bytes, covers, length: int) -> tuple[int, int, int, str, bytes]:
    """(bytes, bytes removed, runs removed, digest of what stays, what stays)."""
    if covers is None or not len(covers):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
    low = np.array([c["low"] for c in covers], np.int64)
    end = np.array([c["low"] + c["wide"] for c in covers], np.int64) + length
    starts, ends = merged_spans(low, end)
    kept = [data[a:b] for a, b in zip(np.concatenate([[0], ends]), np.append(starts, len(data)), strict=True)]
    rest = b"".join(kept)
    return len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(rest).hexdigest(), rest


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_rest: bool = False, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the ``rest`` itself).

    Each byte covered by a string of ``length`` bytes that also starts elsewhere is removed, in every place,
    judged on the input. Null texts are empty; texts below ``length`` bytes stay. Repeated rows repeat each
    other, so long ones lose all their bytes. Rows without id are told apart by their texts only, which is
    enough, for equal rows get equal results. Other columns are not read; an empty table gives no rows.

    No name is gathered in one task: names are counted by partial sums, and the joins that lead back to the
    texts have a shuffle on both sides, which Spark splits where one name has many rows. Texts are shuffled
    once for all uses.
    """
    sampled = sample_table(small_batches(docs), length, gram)
    twice = stored(sampled.groupBy("short").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("short"))
    shared = stored(sampled.join(twice, "short"))
    names = ["short", "long", "wide"]
    long_names = stored(shared.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc", "mark", "low")]))
    several = stored(long_names.groupBy("short").agg(F.count(F.lit(1)).alias("names")).filter("names > 1"))
    whole = shared.join(stored(long_names.filter("n > 1").select(*names)), names).select("doc", "mark", "low", "wide")

    # A repeated row sends its places twice, but none of them is single: its long names have two rows each.
    asked = long_names.join(several, "short").select("doc", "mark", "names", F.struct("short", "low", "wide", (F.col("n") == 1).alias("single")).alias("ask"))
    texts = docs.select(*_keys(docs))

    def with_asked(rows: DataFrame) -> DataFrame:
        return texts.join(rows.groupBy("doc", "mark").agg(F.collect_list("ask").alias("asked")), ["doc", "mark"])  # at most one per sample of a text

    together = strips(with_asked(asked.filter(F.col("names") <= group)), length).repartition("short").sortWithinPartitions("short")
    parts = [whole, together.mapInPandas(lambda it: walk_groups(it, ["short"], repeated_places(length)), "doc long, mark int, low int, wide int")]
    if not several.filter(F.col("names") > group).isEmpty():
        places = stored(named_places(with_asked(asked.filter(F.col("names") > group)), length))
        again = stored(places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"))
        parts.append(places.filter("single").join(again, ["a", "b"]).select("doc", "mark", F.col("place").alias("low"), F.lit(0).alias("wide")))
    covered = reduce(DataFrame.unionByName, parts)
    covers = covered.groupBy("doc", "mark").agg(F.collect_set(F.struct("low", "wide")).alias("covers"))  # bounded by the text

    def finish(data: pd.Series, covers: pd.Series) -> pd.DataFrame:
        rows = [cut(bytes(d), c, length) for d, c in zip(data, covers, strict=True)]
        return pd.DataFrame([r if with_rest else r[:4] for r in rows], columns=columns)

    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["rest"] if with_rest else [])]
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", rest binary" if with_rest else "")
    done = texts.join(covers, ["doc", "mark"], "left").select("doc", F.pandas_udf(finish, kinds)("data", "covers").alias("cut"))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return done.select(doc_id, "cut.*")
