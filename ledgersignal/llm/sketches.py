"""Document fingerprints: bottom-k sketches of word shingles. Only DataFrame operations are used.

The sketch of a text is the ``k`` smallest of the distinct 64-bit hashes of its shingles. The sketch of a
union is the k smallest of the sketches' union, so sketches of parts can be merged. Resemblance is the share
of the union's k smallest that both sketches hold; containment and the number of distinct shingles follow
from the k-th smallest hash. Below k shingles all of these are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.llm.common import text_key, whole_text
from ledgersignal.operators.ranking import ordinal_rank
from ledgersignal.session import cut_lineage

K = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Add the sketch of a text column. Texts of fewer words have one shingle of all words; no words, none."""
    w, keep = f"_{name}_words", df.columns
    split = df.withColumn(w, F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    each = F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(F.col(w), i, words)))
    hashes = F.when(F.size(w) >= words, each).when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    return split.select(*keep, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k).alias(name))


def _unit(h: Column) -> Column:
    """A signed 64-bit hash as a number in (0, 1)."""
    return (h.cast("double") + F.lit(float(2**63)) + 1.0) / F.lit(float(2**64))


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index; 1 for two empty sketches, 0 if one is empty."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / _unit(F.element_at(a, F.lit(k))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty ``a``."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def merge_sketches(df: DataFrame, by: Sequence[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    Equal hashes collapse before the shuffle and each task sends at most k hashes of a group on, so a hot
    group is never gathered. Groups whose sketches are all empty get an empty sketch.
    """
    groups = df.select(*by).distinct()
    hashes = df.select(*by, F.explode(sketch).alias("_h")).distinct()
    order = Window.partitionBy(*by).orderBy("_h")
    kept = hashes.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k)
    lists = kept.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    same = [groups[c].eqNullSafe(lists[c]) for c in by]
    joined = groups.join(lists, same, "left")
    return joined.select(*[groups[c] for c in by], F.coalesce(lists[sketch], F.array().cast("array<bigint>")).alias(sketch))


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text (the half that the next document gives it).

    The next document is the one after in descending id; ties of the id are ordered by text, null ids come
    last, and the last document is followed by the first. Rows equal in id and text are one document and get
    equal results; null texts are empty. A single document is its own next. Other columns are not read.

    Texts are shuffled once by document; each then sends its successor the piece asked for. The order is
    found on rows of ids and lengths only.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn(
        "_key", text_key(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")))
    )
    counted = [F.any_value("doc_id").alias("doc_id"), F.any_value(F.length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("_rows")]
    heads = cut_lineage(rows.groupBy("_key").agg(*counted))
    ranked = ordinal_rank(heads, [F.col("doc_id").desc_nulls_last(), F.col("_key")], "_rank")
    half = F.floor(F.col("n") / 2).cast("int")
    asks = ranked.select(F.col("_key").alias("_to"), "doc_id", "_rows", half.alias("_take"), (F.pmod("_rank", F.lit(heads.count())) + 1).alias("_next"))
    asks = asks.join(ranked.select(F.col("_rank").alias("_next"), "_key"), "_next").drop("_next")

    # Both uses of this table need the same columns, so that they share its shuffle.
    texts = rows.groupBy("_key").agg(F.any_value("text").alias("text"))
    given = with_sketch(texts.join(asks, "_key"), "text", "next_sketch", k, words).select(
        F.col("_to").alias("_key"), "doc_id", "_rows", F.left("text", F.col("_take")).alias("_piece"), "next_sketch"
    )
    both = texts.join(given, "_key").withColumn("n_chars", F.length("text").cast("long"))
    kept = F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    both = both.withColumn("edited", F.concat(kept, F.col("_piece")))
    both = with_sketch(with_sketch(both, "text", "sketch", k, words).drop("text"), "edited", "edited_sketch", k, words)
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch", "next_sketch",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_copy"),
    ).drop("_copy")
