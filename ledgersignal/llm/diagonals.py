"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of length L that occurs in a text with at most k edits shares at least L + 1 - q (k + 1) q-grams
with it, on diagonals (text position minus item position) that differ by at most k. Shared q-grams are
counted in bands of 2 (k + 1) diagonals that overlap by half, so one band holds all of them. Every q-gram of the item
counts once in a band, however often the text repeats it, and repetitions of one character are counted as
runs, so junk lines neither pass the bound nor multiply. Bands that meet the bound are verified by an alignment that is confined to the band's diagonals. Items and texts are compared
without regard to case, folded one code point to one, so places are those of the texts as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import small_batches, stored

Q = 9
#: Edits allowed, as a share of an item's length.
EDIT_SHARE = 0.08
#: Characters of items that are matched in one pass over the texts; more items take more passes.
BLOCK_CHARS = 2_000_000
#: Characters of texts that are hashed at once; longer texts are hashed piece by piece.
CHUNK_CHARS = 500_000
#: Cells of diagonals that are counted at once, and positions of one repeated q-gram that count as one run.
SLICE_CELLS, RUN = 1_000_000, 10_000

BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
SEPARATOR = "\x00"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def case_table() -> np.ndarray:
    """For each code point up to the last with case the one it is folded to; itself if folding changes the length."""
    folded = {}
    for code in range(0x20000):
        char = chr(code)
        one = next((f for f in (char.casefold(), char.lower()) if len(f) == 1), char)
        if one != char:
            folded[code] = ord(one)
    table = np.arange(max(folded) + 1, dtype=np.uint32)
    table[list(folded)] = list(folded.values())
    return table


def fold(text: str, table: np.ndarray) -> str:
    """The text without case, of the same length."""
    if text.isascii():
        return text.lower()
    if len(text) > CHUNK_CHARS:
        return "".join(fold(text[i : i + CHUNK_CHARS], table) for i in range(0, len(text), CHUNK_CHARS))
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cased = c < len(table)
    c[cased] = table[c[cased]]
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hash of the q-gram at each position, by doubling."""
    h, done = c + np.uint64(1), 1
    out, left, length = None, q, 0
    while left:
        if left & 1:
            power = np.uint64(pow(int(BASE), done, 1 << 64))
            out, length = (h, done) if out is None else (out[: max(0, len(c) - length - done + 1)] * power + h[length : length + max(0, len(c) - length - done + 1)], length + done)
        left >>= 1
        if left:
            power = np.uint64(pow(int(BASE), done, 1 << 64))
            h = h[: max(0, len(h) - done)] * power + h[done:]
            done *= 2
    return out[: max(0, len(c) - q + 1)]


def prepare(pairs: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE) -> SimpleNamespace:
    """Items of one block, folded, with their q-grams.

    ``budgets``: edits allowed; ``bounds``: q-grams that must be shared; ``grams``: distinct hashes in order, each
    with its runs (``item``, ``place``, ``many`` equal q-grams in a row) from ``first``; ``table``: filter over the
    top bits of a hash; ``short``: items below q characters, which are searched whole; ``cases``: what texts are
    folded by.
    """
    cases = case_table()
    ids, texts = [p[0] for p in pairs], [fold(p[1], cases) for p in pairs]
    lengths = np.array([len(t) for t in texts], np.int64)
    # The largest budget within the share for which the lemma still asks for a shared q-gram.
    budgets = np.maximum(0, np.minimum(np.floor(lengths * share).astype(np.int64), (lengths - q) // q))
    hashes, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, text in enumerate(texts):
        h = gram_hashes(codes(text), q)
        hashes.append(h)
        item.append(np.full(len(h), i))
        place.append(np.arange(len(h)))
    h, item, place = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
    order = np.argsort(h, kind="stable")  # equal hashes stay in the order of items and places
    h, item, place = h[order], item[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
    runs = np.nonzero(new)[0]
    grams, first = np.unique(h[runs], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return SimpleNamespace(
        ids=ids, texts=texts, budgets=budgets, bounds=np.maximum(1, lengths + 1 - q * (budgets + 1)), grams=grams,
        first=np.append(first, len(runs)), item=item[runs], place=place[runs], many=np.diff(np.append(runs, len(h))), table=table,
        short=[i for i, n in enumerate(lengths) if 0 < n < q], cases=cases,
    )


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def _pairs_upto(x: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of i in 0..m-1 and j in 0..n-1 have i - j <= x."""

    def corner(k: np.ndarray) -> np.ndarray:
        k = np.maximum(k, 0)
        return k * (k + 1) // 2

    y = x + n
    return corner(y) - corner(y - m) - corner(y - n) + corner(y - m - n)


def _hits(joined: str, items: SimpleNamespace, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of q-grams that items have, and which they are."""
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, max(len(joined) - q + 1, 0), CHUNK_CHARS):
        h = gram_hashes(codes(joined[start : start + CHUNK_CHARS + q - 1]), q)
        at = np.nonzero(items.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])[0]
        gram = np.searchsorted(items.grams, h[at])
        known = gram < len(items.grams)
        known[known] = items.grams[gram[known]] == h[at][known]
        places.append(at[known] + start)
        grams.append(gram[known])
    return np.concatenate(places), np.concatenate(grams)


SHIFT = np.int64(1) << 40


def _bands(hits: np.ndarray, gram: np.ndarray, items: SimpleNamespace, offset: int) -> np.ndarray:
    """Keys (item, band) of the bands that share enough q-grams with their item.

    Shared q-grams are counted by cells of half a band, as pairs of runs, one slice of the text after the other.
    Bands that lie behind a slice by more than the longest item are judged and left.
    """
    longest = max(map(len, items.texts))
    new = np.ones(len(hits), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (hits[1:] != hits[:-1] + 1) | (hits[1:] % RUN == 0)
    starts = np.nonzero(new)[0]
    at, gram, length = hits[starts], gram[starts], np.diff(np.append(starts, len(hits)))
    runs = items.first[gram + 1] - items.first[gram]
    slices = np.cumsum(runs * (length + 1)) // SLICE_CELLS
    open_keys, open_counts, reached, enough = np.zeros(0, np.int64), np.zeros(0, np.int64), None, []

    def judge(upto: int | None) -> None:
        """Judge bands that no position from ``upto`` on can add to, and were not judged before."""
        nonlocal open_keys, open_counts, reached
        run, cell = open_keys // SHIFT, open_keys % SHIFT
        wide = items.budgets[items.item[run]] + 1

        def last(position: int | None) -> np.ndarray:
            return (position - longest + offset) // wide - 2 if position is not None else np.full(len(run), SHIFT)

        end, begin = last(upto), last(reached) if reached is not None else np.full(len(run), -1)
        for_own, for_before = (cell > begin) & (cell <= end), (cell - 1 > begin) & (cell - 1 <= end)
        if for_own.any() or for_before.any():
            k, c = _summed([open_keys[for_own], open_keys[for_before] - 1], [open_counts[for_own], open_counts[for_before]])
            own = k // SHIFT
            k, c = _summed([items.item[own] * SHIFT + k % SHIFT], [np.minimum(c, items.many[own])])
            enough.append(k[c >= items.bounds[k // SHIFT]])
        open_keys, open_counts, reached = open_keys[cell > end], open_counts[cell > end], upto

    for part in np.split(np.arange(len(at)), np.nonzero(np.diff(slices))[0] + 1):
        n_runs = runs[part]
        own = np.repeat(part, n_runs)
        run = np.repeat(items.first[gram[part]] - np.concatenate([[0], np.cumsum(n_runs)[:-1]]), n_runs) + np.arange(n_runs.sum())
        wide = items.budgets[items.item[run]] + 1
        base, m, n = at[own] - items.place[run], length[own], items.many[run]
        low, high = (base - n + 1 + offset) // wide, (base + m - 1 + offset) // wide
        cells = high - low + 1
        pair = np.repeat(np.arange(len(run)), cells)
        cell = low[pair] + np.arange(len(pair)) - np.repeat(np.concatenate([[0], np.cumsum(cells)[:-1]]), cells)
        x = cell * wide[pair] - offset - base[pair]
        shared = _pairs_upto(x + wide[pair] - 1, m[pair], n[pair]) - _pairs_upto(x - 1, m[pair], n[pair])
        open_keys, open_counts = _summed([open_keys, run[pair] * SHIFT + cell], [open_counts, shared])
        if len(open_keys) > SLICE_CELLS and part[-1] + 1 < len(at):
            judge(int(at[part[-1] + 1]))
    judge(None)
    return np.concatenate(enough) if enough else np.zeros(0, np.int64)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best place (edits, start, end) of the whole item in the region, on diagonals low..high, or None.

    Of equally good places the one with the smallest start counts, then the smallest end.
    """
    width, n = high - low + 1, len(region)
    scale = np.int64(1 << 32)  # a cell is edits * scale + start, so minima keep the smaller start
    big = np.int64(1 << 60)
    diagonals = np.arange(low, high + 1)
    cells = np.where((diagonals >= 0) & (diagonals <= n), diagonals, big)
    steps = np.arange(width, dtype=np.int64) * scale
    for i, c in enumerate(item):
        at = diagonals + i
        inside = (at >= 0) & (at < n)
        same = np.zeros(width, bool)
        same[inside] = region[at[inside]] == c
        new = np.where(inside, cells + np.where(same, 0, scale), big)
        new[:-1] = np.minimum(new[:-1], cells[1:] + scale)  # a character of the item is missing in the text
        new = np.where((at + 1 >= 0) & (at + 1 <= n), new, big)
        cells = np.minimum.accumulate(new - steps) + steps  # characters of the text that the item lacks
        cells = np.where((at + 1 >= 0) & (at + 1 <= n), cells, big)
    best = int(cells.argmin())
    edits, start = divmod(int(cells[best]), int(scale))
    return (edits, start, best + low + len(item)) if edits <= budget else None


def search(texts: list[str], items: SimpleNamespace, q: int = Q) -> list[list[tuple[int, int, int, int]]]:
    """Per text the places of items: (item id, start, end, edits), in that order, each item and start once."""
    found: list[set] = [set() for _ in texts]
    if not items.ids:
        return [[] for _ in texts]
    texts = [fold(t, items.cases) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hits, gram = _hits(SEPARATOR.join(texts), items, q)
    offset = (1 << 20) + max(map(len, items.texts))  # diagonals before the first text are negative
    for key in _bands(hits, gram, items, offset) if len(hits) else ():
        i, b = divmod(int(key), int(SHIFT))
        w, size, budget = int(items.budgets[i]) + 1, len(items.texts[i]), int(items.budgets[i])
        low, high = b * w - offset, (b + 2) * w - 1 - offset
        # The band may reach over the border of two texts; each is searched by itself.
        first = max(0, int(np.searchsorted(starts, low, "right")) - 1)
        last = min(len(texts) - 1, max(first, int(np.searchsorted(starts, high + size, "right")) - 1))
        for d in range(first, last + 1):
            text, begin = texts[d], int(starts[d])
            a = max(0, low - budget - begin)
            region = text[a : max(a, high + size + budget - begin)]
            if len(region) < size - budget:
                continue
            exact = region.find(items.texts[i])
            if exact >= 0:
                found[d].add((items.ids[i], a + exact, a + exact + size, 0))
                continue
            got = align(codes(items.texts[i]), codes(region), low - begin - a - budget, high - begin - a + budget, budget)
            if got:
                found[d].add((items.ids[i], a + got[1], a + got[2], got[0]))
    for i in items.short:
        for d, text in enumerate(texts):
            at = text.find(items.texts[i])
            while at >= 0:
                found[d].add((items.ids[i], at, at + len(items.texts[i]), 0))
                at = text.find(items.texts[i], at + 1)
    return [sorted(f) for f in found]


PLACES = "array<struct<item_id: long, start: long, end: long, edits: long>>"


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters, fetched one block at a time."""
    items = benchmark.filter(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    dealt = items if n < 2 else stored(items)
    for b in range(n):
        yield [tuple(r) for r in dealt.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()]


def _matcher(items, q: int):
    """Column function that searches texts for a broadcast block of items, some megabytes of text at a time."""

    def match(texts: pd.Series) -> pd.Series:
        found, chunk, size = [], [], 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                found += search(chunk, items.value, q)
                chunk, size = [], 0
        found += search(chunk, items.value, q) if chunk else []
        return pd.Series([[dict(zip(("item_id", "start", "end", "edits"), p, strict=True)) for p in places] for places in found])

    return F.pandas_udf(match, PLACES)


def _places(text: Column, block: list[tuple[int, str]], docs: DataFrame, q: int, share: float) -> Column:
    """The places of one block of items in a text. What is broadcast is bounded by the block."""
    context = small_batches(docs).sparkSession.sparkContext
    return _matcher(context.broadcast(prepare(block, q, share)), q)(F.coalesce(text, F.lit("")))


def find_items(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the number of items found, their ids, and their places.

    Whole items are looked for, with at most ``EDIT_SHARE`` of their length in edits (fewer where the lemma
    would ask for no shared q-gram; items shorter than a q-gram must occur whole). Case does not count: letters
    are folded one to one, those that have no such fold (as in ``ß`` and ``SS``) differ. Null and empty texts
    hold no item; null and empty items, and items without id, are not looked for; equal items with different
    ids are all reported. Other columns are not read; an empty table gives no rows.

    Up to ``block_chars`` characters of items take one scan and no shuffle. More of them take a scan per block;
    the driver and the tasks hold one block at a time, and what a block finds is written and joined.
    """
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        found = docs.select("doc_id", F.array().cast(PLACES).alias("places"))
    elif second is None:
        found = docs.select("doc_id", _places(F.col("text"), first, docs, q, share).alias("places"))
    else:
        rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"))
        parts = [stored(rows.select("_row", _places(F.col("text"), b, docs, q, share).alias("places")).filter(F.size("places") > 0)) for b in chain((first, second), blocks)]
        places = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.flatten(F.collect_list("places")).alias("places"))
        found = rows.select("_row", "doc_id").join(places, "_row", "left").select("doc_id", F.coalesce("places", F.array().cast(PLACES)).alias("places"))
    ids = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["item_id"])))
    return found.select("doc_id", F.size(ids).alias("n_items"), ids.alias("items"), "places")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; a block sees what earlier ones kept."""
    kept = docs
    for number, block in enumerate(_blocks(benchmark, block_chars)):
        kept = stored(kept) if number else kept
        kept = kept.filter(F.size(_places(F.col("text"), block, docs, q, share)) == 0)
    return kept
