"""Jaccard join of word shingle sets by chosen paths.

In each run a set chooses some of its tokens by a hash, each with probability ``RATE / size``; sets that
choose a common token meet in the node of that token. A node with more than ``LIMIT`` sets is split: every
set of it chooses again, by a hash of the path so far, down to ``DEPTH`` tokens. What is left is compared by
brute force, large nodes in pairs of blocks. Runs are repeated until the target recall is met for the worst
pair at the threshold: one set inside the other, in nodes of the last level.

A pair that meets in several nodes belongs to the one with the smallest number, so it is compared and counted
once and pairs need not be written. Within nodes, small sketches exclude most pairs; the rest is compared
by whole shingle sets, so every link is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import Rows, small_batches, stored, text_key, walk_groups, whole_text
from ledgersignal.operators.network import connected_components
from ledgersignal.session import cut_lineage

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
RATE, DEPTH, LIMIT = 1.5, 2, 200
#: Blocks of a node have at most so many sets, and texts of about so many characters.
BLOCK_SETS, BLOCK_CHARS = 1_000, 6_000_000
BINS = 128
NO_ID = 2**63 - 1
WORDS_KEPT = 300_000


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, rate: float = RATE, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    The common choices of a pair with one set inside the other are a branching process whose mean is
    ``rate * threshold``; the pair meets if it lives for ``depth`` levels.
    """
    lives = 1.0
    for _ in range(depth):
        lives = 1 - math.exp(-rate * threshold * lives)
    return math.ceil(math.log(1 - recall) / math.log(1 - lives))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingles of texts; hashes of words are kept, up to a bound."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.kept = words, {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.split()
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for w in set(tokens):
            if w not in kept:
                kept[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        h = np.fromiter(map(kept.__getitem__, tokens), np.uint64, len(tokens))
        n = max(1, len(h) - self.words + 1) if len(h) else 0
        out = np.zeros(n, np.uint64)
        for i in range(min(self.words, len(h))):  # a text of fewer words has one shingle of all of them
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def chosen(tokens: np.ndarray, paths: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the path, new path) for each token that a path chooses."""
    share = min(1.0, rate / len(tokens))
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    parents, new = [], []
    step = max(1, 4_000_000 // len(tokens))
    for a in range(0, len(paths), step):
        at, token = np.nonzero(_mix(tokens[None, :] ^ paths[a : a + step, None]) <= limit)
        parents.append(at + a)
        new.append(_mix(paths[at + a] * np.uint64(0xD6E8FEB86659FD93) + tokens[token]))
    return np.concatenate(parents), np.concatenate(new)


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of the smallest token in each of the bins; 0 where a bin has none."""
    bins = (tokens >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = ((tokens[first] >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def _path_type(depth: int) -> str:
    return "struct<node: long>" if depth == 1 else f"struct<node: long, kids: array<{_path_type(depth - 1)}>>"


def _tree(tokens: np.ndarray, roots: np.ndarray, rate: float, depth: int) -> list[dict]:
    """The nodes that a set goes to, each with those below it."""
    levels, paths = [], roots
    for _ in range(depth):
        parent, new = chosen(tokens, paths, rate) if len(paths) else (np.empty(0, np.int64), np.empty(0, np.uint64))
        levels.append((parent.tolist(), new.astype(np.int64).tolist()))
        paths = new
    below: list[list[dict]] = [[] for _ in levels[-1][1]]
    for level in range(depth - 1, -1, -1):
        parents, nodes_ = levels[level]
        above: list[list[dict]] = [[] for _ in (levels[level - 1][1] if level else [0])]
        for at, node, kids in zip(parents, nodes_, below, strict=True):
            above[at if level else 0].append({"node": node} if level == depth - 1 else {"node": node, "kids": kids})
        below = above
    return below[0]


def set_table(docs: DataFrame, words: int, rate: float, runs: int) -> DataFrame:
    """One row per distinct text: key, lowest id, number of copies, sketch and the tree of its nodes, empty without words."""

    names = ["key", "doc", "chars", "sketch", "tree"]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            rows = []
            for key, doc, text in zip(batch["key"], batch["doc"], batch["text"], strict=True):
                tokens = shingles(text)
                known = (sketch(tokens), _tree(tokens, roots, rate, DEPTH)) if len(tokens) else (bytes(BINS), [])
                rows.append((key, doc, len(text), *known))
                if len(rows) == 1000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    keyed = docs.select(text_key(whole_text()).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), whole_text().alias("text"))
    found = keyed.mapInPandas(describe, f"key binary, doc long, chars int, sketch binary, tree array<{_path_type(DEPTH)}>")
    kept = [F.any_value(c).alias(c) for c in ("chars", "sketch", "tree")]
    return found.groupBy("key").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), *kept)


def nodes(sets: DataFrame, limit: int) -> DataFrame:
    """(node, n, node_chars, key) for the nodes that are compared: small ones of every level, all of the last."""
    done = []
    paths = sets.select("key", "chars", F.explode("tree").alias("_p")).select("key", "chars", "_p.*")
    for level in range(1, DEPTH + 1):
        counts = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("node_chars")).filter("n > 1")
        met = stored(paths.join(stored(counts), "node"))
        last = level == DEPTH
        done.append((met if last else met.filter(F.col("n") <= limit)).select("node", "n", "node_chars", "key"))
        large = met.filter(F.col("n") > limit)
        if last or large.isEmpty():
            break
        paths = large.select("key", "chars", F.explode("kids").alias("_p")).select("key", "chars", "_p.*")
    return reduce(DataFrame.unionByName, done)


def _in_blocks(members: DataFrame, block_sets: int, block_chars: int) -> DataFrame:
    """One row per member and pair of blocks (x <= y) of its node that it takes part in."""
    g = F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("node_chars") / block_chars)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_g")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    return members.withColumn("_g", g).withColumn("own", own).withColumn("_pair", F.explode(pair)).withColumns({"x": F.col("_pair.x"), "y": F.col("_pair.y")}).drop("_g", "_pair", "n", "node_chars")


def _shared(rows: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Numbers of common elements of each two lists, by products of slices of their incidence table."""
    n = len(rows)
    lengths = [len(r) for r in rows]
    values, inverse, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lengths)
    rank = np.full(len(values), -1, np.int64)
    common = np.nonzero(counts > 1)[0]
    rank[common] = np.arange(len(common))
    at = rank[inverse]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, len(common), columns):
        lo, hi = np.searchsorted(at, [a, a + columns])
        table = np.zeros((n, min(columns, len(common) - a)), np.float32)
        table[owner[lo:hi], at[lo:hi] - a] = 1
        out += table @ table.T
    return out


def _owned(rows: Rows) -> np.ndarray:
    """Pairs i < j of the two blocks that have no smaller node in common."""
    node, own = rows["node"][0], rows["own"]
    n = len(own)
    smaller = [a[a < node] for a in rows["nodes"]]
    if n == 2:
        pair = (rows["x"][0] == rows["y"][0] or own[0] != own[1]) and not np.isin(smaller[0], smaller[1]).any()
        return np.array([[False, pair], [False, False]])
    first = np.triu(np.ones((n, n), bool), 1)
    if rows["x"][0] != rows["y"][0]:
        first &= own[:, None] != own[None, :]
    smaller = [np.unique(a) for a in smaller]
    if sum(map(len, smaller)):
        first &= _shared(smaller) == 0
    return first


def _candidates(threshold: float):
    def near(rows: Rows) -> Rows | None:
        n = len(rows["key"])
        if n < 2:
            return None
        owned = _owned(rows)
        if not owned.any():
            return None
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(n, BINS)
        full = sketches > 0
        hit = np.zeros(n, bool)
        for i in np.nonzero(owned.any(axis=1))[0]:
            j = np.nonzero(owned[i])[0]
            either = (full[j] | full[i]).sum(axis=1)
            same = ((sketches[j] == sketches[i]) & full[i]).sum(axis=1)
            slack = 5 * np.sqrt(threshold * (1 - threshold) / either)
            close = same / either >= threshold - slack
            hit[j[close]] = True
            hit[i] |= close.any()
        return {c: rows[c][hit] for c in ("node", "own", "x", "y", "key", "doc", "nodes")} if hit.any() else None

    return near


def _links(threshold: float, words: int):
    shingles = Shingler(words)

    def compare(rows: Rows) -> Rows | None:
        once = list({k: i for i, k in enumerate(rows["key"])}.values())  # a repeated row of the table brings its text again
        rows = {c: v[once] for c, v in rows.items()}
        n = len(once)
        if n < 2:
            return None
        owned = _owned(rows)
        sets = [shingles(t) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets)
        linked = owned
        for i in range(n):  # row by row, to hold no table of doubles
            linked[i] &= both[i] >= threshold * (sizes[i] + sizes - both[i]) - 1e-6
        count = linked.sum(axis=0) + linked.sum(axis=1)
        if not count.any():
            return None
        root = np.arange(n)  # the smallest member reached through links, for a forest of edges
        linked |= linked.T
        todo = set(range(n))
        while todo:
            seed = min(todo)
            reached, edge = np.zeros(n, bool), np.array([seed])
            reached[seed] = True
            while len(edge):
                new = linked[edge].any(axis=0) & ~reached
                reached |= new
                edge = np.nonzero(new)[0]
            root[reached] = seed
            todo -= set(np.nonzero(reached)[0].tolist())
        keys = rows["key"]
        kept = count > 0
        return {"key": keys[kept], "root": keys[root[kept]], "links": count[kept]}

    return compare


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE, recall: float = RECALL, rate: float = RATE, limit: int = LIMIT) -> DataFrame:
    """Classes of near-duplicate texts: key (128-bit hash of the text), doc, copies, links, root doc and key.

    One row per distinct text; those without words are in no node and have no links. ``doc`` is the lowest id of its rows, ``links`` the number of other
    texts whose shingle sets have the threshold's Jaccard index with its own or more, ``root_doc`` and
    ``root_key`` the lowest (id, key) of the class that links connect.
    """
    sets = stored(set_table(small_batches(docs), words, rate, runs_needed(threshold, recall, rate)))
    members = nodes(sets, limit)
    met = members.groupBy("key").agg(F.collect_list("node").alias("nodes"))  # bounded by runs and rate
    placed = _in_blocks(members.join(met, "key").join(sets.select("key", "doc", "sketch"), "key"), BLOCK_SETS, BLOCK_CHARS)
    group = ["node", "x", "y"]
    near = _candidates(threshold)
    kinds = "node long, own int, x int, y int, key binary, doc long, nodes array<long>"
    dealt = placed.repartition(*group).sortWithinPartitions(*group)
    candidates = stored(dealt.mapInPandas(lambda it: walk_groups(it, group, near), kinds))
    texts = docs.select(text_key(whole_text()).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), whole_text().alias("text"))
    dealt = candidates.join(texts, ["key", "doc"]).repartition(*group).sortWithinPartitions(*group)
    found = stored(dealt.mapInPandas(lambda it: walk_groups(it, group, _links(threshold, words)), "key binary, root binary, links long"))
    edges = found.filter(F.col("key") != F.col("root")).select(F.col("key").alias("src"), F.col("root").alias("dst"), F.lit(1).cast("long").alias("txn_count")).distinct()
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = sets.select("key", "doc", "copies").join(links, "key", "left").fillna(0, ["links"])
    if edges.isEmpty():
        return linked.select("*", F.col("doc").alias("root_doc"), F.col("key").alias("root_key"))
    groups = connected_components(edges).select(F.col("node").alias("key"), "component")
    linked = linked.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    roots = linked.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("root"))
    return linked.join(roots, "component").select("key", "doc", "copies", "links", F.col("root.doc").alias("root_doc"), F.col("root.key").alias("root_key"))


def join_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links.

    ``class_id`` is the lowest id of the class that links connect, ``copy_id`` the lowest id of rows with the
    same text, ``n_links`` the number of different texts linked to this one. Texts below five words have one
    shingle of all their words. Null, empty and white texts have no shingle and no link; they form classes of
    equal texts. Rows without id come last in the choice of ids; a class of such rows has a null id. Other
    columns are not read; an empty table gives no rows.
    """
    classes = cut_lineage(near_classes(docs, **settings).select("key", "doc", "links", "root_doc"))
    rows = docs.select("doc_id", text_key(whole_text()).alias("key"))
    number = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias({"root_doc": "class_id", "doc": "copy_id"}[c])
    return rows.join(classes, "key").select("doc_id", number("root_doc"), number("doc"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: a row with the class's lowest id.

    Of equal ids the text with the lowest hash counts, of repeated rows any. Texts without words form classes
    of equal texts.
    """
    roots = cut_lineage(near_classes(docs, **settings).select("key", "root_key", "doc").filter(F.col("key") == F.col("root_key")).select("key", "doc"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, text_key(whole_text()).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    return keyed.join(roots, ["key", "doc"]).dropDuplicates(["key"]).select("row.*")
