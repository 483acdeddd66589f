"""The registered queries of this folder, with the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersignal.llm import assignments, chosen_path, curriculum, diagonals, hash_tree, norm_buckets, packing, permuterm, sentence_spans, sketches, suffix_cover, toxicity, trie_counts
from ledgersignal.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_cover.remove_repeats(read(spark, sf_dir, "documents"))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join_documents(read(spark, sf_dir, "documents"))


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = trie_counts.count_tokens(read(spark, sf_dir, "documents"), trie_counts.default_model(spark))
    return counted.select("doc_id", "n_pretokens", "n_tokens", F.round("log_score", 6).alias("log_score"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments.find_secrets(read(spark, sf_dir, "documents"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curriculum.by_position(curriculum.mix(read(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("first_position", 9).alias("first_position")
    )


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonals.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketches.fingerprint_documents(read(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.as_text(own).alias("fingerprint"),
        sketches.as_text(edited).alias("edited_fingerprint"),
        sketches.resemblance(own, edited).alias("near_edited"),
        sketches.resemblance(own, following).alias("near_next"),
        sketches.distinct_count(own).alias("distinct_shingles"),
        sketches.containment(edited, own).alias("edited_contained"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(read(spark, sf_dir, "documents"), packing.default_tokenizer(spark))
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.spelling_variants(read(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][(number - 1) % 3 + 1]::DOUBLE AS tilt FROM sources
), filled AS (
  SELECT *, row_number() OVER fill AS i,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0) AS DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed
  WINDOW fill AS (ORDER BY source_size / weight, number),
         earlier AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT arg_min(level, i) AS level FROM filled WHERE NOT (3 * source_size < level * weight)
), targets AS (
  SELECT source, source_size, tilt, least(CAST(3 * source_size AS DOUBLE), common.level * weight) AS target FROM filled, common
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt,
         CAST(least(floor(t.target + 0.5), 3 * t.source_size) AS BIGINT) AS words,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, md5(coalesce(s.text, ''))
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS turns FROM placed
), parts AS (
  SELECT *, greatest(0, least(size, words - turns * source_size - start)) AS part FROM taken
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(turns * size + part AS BIGINT) AS taken,
       CASE WHEN size = 0 OR turns * size + part = 0 THEN NULL WHEN start = 0 THEN 0.0
            ELSE round(2 * (start / words) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (start / words))), 9) END AS first_position
FROM parts
"""

SEARCH_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), item AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), total AS (
  SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM doc
), asked AS (
  SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM item) GROUP BY i, term
), tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) GROUP BY r, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), scored AS (
  SELECT a.i, t.r,
         CAST(sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + ((75 * len(d.terms) * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weighed w USING (term) JOIN doc d ON d.r = t.r CROSS JOIN total
  GROUP BY a.i, t.r
), ranked AS (
  SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored JOIN doc USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN doc USING (r) JOIN item USING (i) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chosen_path": op3_chosen_path,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_secrets": op5_secrets,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_mix_sources": op7_mix_sources,
    "op8_hash_tree_shards": op8_hash_tree_shards,
    "op9_decontaminate": op9_decontaminate,
    "op10_fingerprints": op10_fingerprints,
    "op11_lexical_search": op11_lexical_search,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op7_mix_sources": MIX_SQL, "op11_lexical_search": SEARCH_SQL}
