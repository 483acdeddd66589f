"""Ranked lexical search by buckets of vector length.

A document is a vector with one coordinate per term of the items: the term's weight times its saturated
frequency, a whole number. An item is a vector of its terms' occurrences, and a score their inner product.
Documents are bucketed by the length of their vectors. An item's score in a bucket is at most its own length
times the bucket's largest (Cauchy-Schwarz), so an item skips buckets that cannot reach its tenth score. In a
bucket that it enters, the largest coordinates of the bucket tell which of the item's terms a document must
have at least one of; the terms found and the length of what is left of both vectors bound the rest. Documents
that pass are scored in whole numbers.

Bounds are computed in doubles and widened by ``SLACK``, so rounding never drops a document. Thresholds start
from sums over the leading documents of every term, which scores cannot be below.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.llm.common import small, stored
from ledgersignal.operators.ranking import attach_row

K = 10
#: Leading documents of a term from which first thresholds are made.
LEADERS = 32
#: Ratio of the longest to the shortest vector of a bucket, and coordinates that a block of a bucket has about.
RATIO, BLOCK_COORDINATES = 1.2, 200_000
#: Items that meet a block at once.
ITEM_BLOCK = 2_000
SLACK = 1.0 + 1e-9
#: Bytes of text that are split at once.
PIECE_BYTES = 4_000_000

#: Digits and letters stay, A to Z in small letters; all other ASCII characters become spaces.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Counter[bytes]:
    """Terms of a text in UTF-8 with their occurrences."""
    flat = text.encode("utf-8", "replace").translate(_KEEP)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE_BYTES)
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


def term_lists(df: DataFrame, key: str, sieve: DataFrame | None = None) -> DataFrame:
    """(row, key, n, terms, tfs) of rows with terms. ``row`` tells rows apart.

    ``sieve`` is a bitmap of term hashes of fixed size; terms outside it are counted in n and left out.
    """
    bits = None if sieve is None else df.sparkSession.sparkContext.broadcast(_bits(sieve))
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row, own, text in zip(batch["row"], batch[key], batch["text"], strict=True):
                found = terms_of(text)
                if not found:
                    continue
                kept, tfs = list(found), np.fromiter(found.values(), np.int64, len(found))
                if bits is not None:
                    inside = bits.value[np.fromiter(map(_place, kept), np.int64, len(kept))]
                    kept, tfs = [t for t, k in zip(kept, inside, strict=True) if k], tfs[inside]
                rows.append((row, own, found.total(), [t.decode("utf-8", "replace") for t in kept], tfs))
                held += len(kept)
                if held > BLOCK_COORDINATES:
                    yield pd.DataFrame(rows, columns=["row", key, "n", "terms", "tfs"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["row", key, "n", "terms", "tfs"])

    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInPandas(read, f"row long, {key} string, n long, terms array<string>, tfs array<long>")
    return out.withColumn(key, F.col(key).cast(kind))


SIEVE_BITS = 1 << 24


def _place(term: bytes) -> int:
    return zlib.crc32(term) & (SIEVE_BITS - 1)


def term_sieve(terms: DataFrame) -> DataFrame:
    """Bitmaps of the hashes of ``term``: at most 512 rows of 4 KB however many terms there are."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(SIEVE_BITS)) + 1  # positive places are numbered from 1, as buckets are
    buckets = terms.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return buckets.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _bits(sieve: DataFrame) -> np.ndarray:
    size = 8 * 4096
    out = np.zeros(SIEVE_BITS, bool)
    for r in sieve.collect():  # bounded by SIEVE_BITS
        out[(r.bucket - 1) * size : r.bucket * size] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out


def impact(tf: Column, length: Column, documents: int, terms: int) -> Column:
    """Saturated frequency in whole numbers: (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 length documents) div terms."""
    wide = F.lit(75).cast("decimal(38,0)") * length.cast("decimal(19,0)") * F.lit(documents).cast("decimal(19,0)")
    share = wide.cast("decimal(38,0)") / F.lit(terms).cast("decimal(19,0)")
    m = F.lit(25).cast("long") + F.floor(share).cast("long")
    return F.call_function("div", F.lit(10**9).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * m)


def weight(df: Column, documents: int) -> Column:
    """Floor of 1000 ln((2 documents + 2) / (2 df + 1))."""
    return F.floor(1000.0 * F.log(F.lit(float(2 * documents + 2)) / (2 * df + 1).cast("double")))


def search_block(docs: pd.DataFrame, items: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The ``k`` best documents of one block for every item that entered it, exactly.

    ``docs``: row, doc, missing, norm, ids and values (lists per document); ``items``: item, threshold, ids and counts.
    """
    nothing = docs.iloc[:0][["row", "doc", "missing"]].assign(item=np.zeros(0, np.int64), score=np.zeros(0, np.int64))
    if not len(docs) or not len(items):
        return nothing
    lengths = docs["ids"].map(len).to_numpy()
    ids, values = np.concatenate(docs["ids"].to_list()), np.concatenate(docs["values"].to_list())
    order = np.argsort(ids, kind="stable")
    ids, values, owners = ids[order], values[order], np.repeat(np.arange(len(docs)), lengths)[order]
    squares = docs["norm"].to_numpy(float) ** 2
    top = squares.max(initial=0.0)
    by_id = np.argsort(docs["doc"].to_numpy(), kind="stable")
    place = np.empty(len(docs), np.int64)  # order of ids, missing ones last
    place[by_id[np.argsort(docs["missing"].to_numpy()[by_id], kind="stable")]] = np.arange(len(docs))
    out = []
    scores, squared = np.zeros(len(docs), np.int64), np.zeros(len(docs))
    for item, threshold, wanted, counts in zip(items["item"], items["threshold"], items["ids"], items["counts"], strict=True):
        left, right = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
        has = right > left
        left, right, counts = left[has], right[has], np.asarray(counts)[has]
        if not len(left):
            continue
        largest = np.array([values[a:b].max() for a, b in zip(left, right, strict=True)])
        # Terms by what they can add, least first: a document without the later ones cannot reach the threshold.
        by_use = np.argsort(counts * largest, kind="stable")
        sums = np.cumsum((counts * largest)[by_use].astype(float))
        lens = np.sqrt(np.cumsum(counts[by_use].astype(float) ** 2) * top)
        spare = int(np.searchsorted(np.minimum(sums, lens) * SLACK, max(threshold, 1.0), "left"))
        if spare == len(by_use):
            continue
        needed, rest = by_use[spare:], by_use[:spare]
        for t in needed:
            who = owners[left[t] : right[t]]
            value = values[left[t] : right[t]]
            scores[who] += counts[t] * value
            squared[who] += value.astype(float) ** 2
        found = np.nonzero(scores)[0]
        if len(rest):
            most = sums[spare - 1]
            length = math.sqrt(float((counts[rest].astype(float) ** 2).sum()))
            bound = scores[found] + np.minimum(most, length * np.sqrt(np.maximum(squares[found] * SLACK - squared[found], 0.0)))
            reaching = found[bound * SLACK >= threshold]
            for t in rest:
                who = owners[left[t] : right[t]]
                at = np.searchsorted(who, reaching)
                at[at == len(who)] = 0
                hit = who[at] == reaching
                scores[reaching[hit]] += counts[t] * values[left[t] : right[t]][at[hit]]
        else:
            reaching = found[scores[found] >= threshold]
        if len(reaching) > k:
            reaching = reaching[np.lexsort((place[reaching], -scores[reaching]))[:k]]
        out.append(docs[["row", "doc", "missing"]].iloc[reaching].assign(item=item, score=scores[reaching]))
        scores[found], squared[found] = 0, 0.0
    return pd.concat(out, ignore_index=True) if out else nothing


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` the ``k`` best rows of ``docs``, scores above 0.

    Equal scores go by ascending id, null ids last; rows with equal ids count each. Texts are read whole; null
    texts, texts without terms, and terms in no document score nothing. Repeated items are answered each. Other
    columns are not read; an empty table gives no rows.

    Texts are read once into vectors over the items' terms, which a bitmap of fixed size sifts and a join makes
    exact. Items are sent to the blocks of the buckets they may not skip, and nothing but counts and the
    bitmap passes the driver. Blocks have about equally many coordinates; a block sends its best on.
    """
    spark = docs.sparkSession
    asked = stored(term_lists(items, "item_id"))
    query = asked.select(F.col("row").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("_t"))
    query = query.select("item", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("count"))
    lists = stored(term_lists(docs, "doc_id", term_sieve(query.select("term").distinct())))
    sizes = lists.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()

    # Weights of the items' terms; other terms that the bitmap let through fall out here.
    found = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = query.select("term").distinct().join(found, "term")
    known = stored(
        known.select("term", F.xxhash64(F.lit(1), "term").alias("id"), weight(F.col("df"), sizes.documents).alias("weight")).filter("weight > 0")
    )
    wanted = stored(query.join(small(known), "term").select("item", "id", "count"))

    each = lists.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("_t"))
    each = each.select("row", "doc_id", "n", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf")).join(small(known), "term")
    value = F.col("weight") * impact(F.col("tf"), F.col("n"), sizes.documents, sizes.terms)
    coordinates = each.select("row", "doc_id", "id", value.alias("value")).filter("value > 0")
    # A list has at most as many entries as the items have terms.
    gathered = coordinates.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"), F.collect_list("id").alias("ids"), F.collect_list("value").alias("values")
    )
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    bucketed = gathered.withColumn("norm", norm).withColumn("bucket", F.floor(F.log("norm") / math.log(RATIO)).cast("int"))
    vectors = stored(bucketed)

    thresholds = _first_thresholds(vectors, wanted, k)
    vectors_of = wanted.groupBy("item").agg(
        F.collect_list("id").alias("ids"),
        F.collect_list("count").alias("counts"),
        F.sqrt(F.sum(F.col("count").cast("double") * F.col("count"))).alias("length"),
    )
    queries = vectors_of.join(thresholds, "item", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1).cast("long")))
    buckets = vectors.groupBy("bucket").agg(F.max("norm").alias("longest"), F.sum(F.size("ids")).alias("coordinates"))
    buckets = buckets.withColumn("blocks", F.floor(F.col("coordinates") / BLOCK_COORDINATES).cast("int") + 1)
    # At most some hundred buckets: lengths are below 2^63.
    listed = attach_row(queries, buckets.agg(F.collect_list(F.struct("bucket", "longest", "blocks")).alias("buckets")))
    reached = F.filter("buckets", lambda b: F.col("length") * b["longest"] * SLACK >= F.col("threshold"))
    entering = listed.withColumn("_b", F.explode(reached)).select("item", "threshold", "ids", "counts", "_b.bucket", "_b.blocks")
    entering = entering.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(1 + asked.count() // ITEM_BLOCK)).cast("int"))
    entering = stored(entering.select("bucket", "blocks", "part", "item", "threshold", "ids", "counts"))
    sent = entering.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    parts = entering.select("bucket", "blocks", F.col("part").alias("part")).distinct()
    kind = docs.schema["doc_id"].dataType
    filler = F.lit("0" if kind.simpleString() != "string" else "").cast(kind)
    dealt = vectors.join(F.broadcast(parts), "bucket").select(
        "bucket", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "part", "row",
        F.coalesce("doc_id", filler).alias("doc"), F.col("doc_id").isNull().alias("missing"), "norm", "ids", "values",
    )
    block = ["bucket", "block", "part"]

    def search(asking: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
        return search_block(having, asking, k)

    columns = f"item long, row long, doc {kind.simpleString()}, missing boolean, score long"
    best = sent.groupBy(*block).cogroup(dealt.groupBy(*block)).applyInPandas(search, columns)
    best = best.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("item"), "item_id")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _first_thresholds(vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(item, threshold): what an item's k-th best score is at least.

    Every term has its leading documents; sums over the item's terms that a document leads in are below its score.
    """
    pairs = vectors.select("row", F.explode(F.arrays_zip("ids", "values")).alias("_c")).select("row", F.col("_c.ids").alias("id"), F.col("_c.values").alias("value"))
    leading = Window.partitionBy("id").orderBy(F.desc("value"), "row")
    leaders = pairs.withColumn("_i", F.row_number().over(leading)).filter(F.col("_i") <= LEADERS).drop("_i")
    sums = wanted.join(leaders, "id").groupBy("item", "row").agg(F.sum(F.col("count") * F.col("value")).alias("sum"))
    ordered = Window.partitionBy("item").orderBy(F.desc("sum"), "row")
    return sums.withColumn("_i", F.row_number().over(ordered)).filter(F.col("_i") == k).select("item", F.col("sum").alias("threshold"))
