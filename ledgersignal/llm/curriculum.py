"""Mixing sources to target weights over training time.

Source ``s`` has the weight schedule ``w_s(t) = w_s * (1 + tilt_s * (2t - 1))`` for training time t in
[0, 1]. Its integral gives the source's share, its running integral the cumulative word demand. The words
of a source form one stream: its documents in the order of a hash, repeated as often as needed. The demand
curve is inverted at the stream offset where a pass over a document begins, which is the training position
of that pass; documents are then range-sorted by position. Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.llm.common import small, text_key, whole_text
from ledgersignal.operators.ranking import running_totals
from ledgersignal.session import cut_lineage

# Average weights and tilts that sources get in turn, and how often a source may repeat.
WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 0.0, -0.5)
CAP = 3

WORD = r"[^\x20\x09-\x0D]+"


def _in_turn(number: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(number - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, cap: int = CAP) -> DataFrame:
    """Per source (``_null``, ``_source``): number, size, weight, tilt and target words.

    The total of all sizes is shared by weight; targets stop at ``cap`` sizes and the excess goes to the
    others by weight. In closed form: sources in the order of size per weight reach their caps first, so the
    level is that of the first source whose cap is not below its share of what the earlier ones leave.
    """
    sizes = sized.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"))
    numbered = sizes.select("*", F.row_number().over(Window.orderBy("_null", "_source")).alias("number"))
    weighed = numbered.select("*", _in_turn(F.col("number"), weights).alias("weight"), _in_turn(F.col("number"), tilts).alias("tilt"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.select("*", F.row_number().over(fill).alias("_i"), (left / weight_left).alias("_level"))
    full = cap * F.col("source_size") < F.col("_level") * F.col("weight")
    level = F.min(F.when(~full, F.struct("_i", "_level"))).over(every)["_level"]
    shared = levels.select("*", level.alias("_common"))
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("_common") * F.col("weight"))
    return shared.select("_null", "_source", "number", "source_size", "weight", "tilt", target.alias("target"))


def _position(offset: Column) -> Column:
    """Training time at which the demand of a source reaches ``offset`` words: the inverse of (1-a)t + at²."""
    share, a = offset / F.col("_words"), F.col("tilt")
    return F.when(offset <= 0, 0.0).otherwise(2 * share / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * share)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, cap: int = CAP) -> DataFrame:
    """Per row of ``docs``: size, its source's size and target, words taken, and the positions of its passes.

    A source whose target is q times its size and a rest gives every document q times, and the first
    documents of its order once more, up to the rest; the one document at the end gives part of its words, so
    a source's words equal its rounded target. Null texts and texts of white space have size 0, take 0 words
    and have no position; null sources form the last source; equal rows are told apart only by their place
    in the order. Other columns are not read. An empty table gives no rows. Hot sources are summed over
    ranges of the order, never in one task.
    """
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_order"),
        text_key(whole_text()).alias("_text"),
    )
    rows = cut_lineage(rows)
    targets = cut_lineage(source_targets(rows.select("_null", "_source", "size"), weights, tilts, cap))
    joined = rows.join(small(targets), ["_null", "_source"]).drop("_null")
    placed = running_totals(joined, ["number"], ["_order", "doc_id", "_text"], ["size"])
    goal = F.least(F.floor(F.col("target") + 0.5), cap * F.col("source_size")).cast("long")
    size, whole = F.col("size"), F.col("source_size")
    placed = placed.withColumn("_words", goal).withColumn("_turns", F.when(whole > 0, F.expr("_words div source_size")).otherwise(F.lit(0)).cast("long"))
    rest = F.col("_words") - F.col("_turns") * whole
    placed = placed.withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(size, rest - F.col("before_size"))))
    passes = F.when(size > 0, F.col("_turns") + F.when(F.col("_part") > 0, 1).otherwise(0)).otherwise(0)
    starts = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<bigint>"))
    return placed.withColumn("_starts", starts).select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("_turns") * size + F.col("_part")).cast("long").alias("taken"),
        F.transform("_starts", lambda i: _position(i * whole + F.col("before_size"))).alias("positions"),
        "_text",
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """The documents range-sorted by their first training position; those not taken come last."""
    first = F.when(F.size("positions") > 0, F.element_at(F.col("positions"), F.lit(1)))
    return mixed.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def passes(mixed: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by training position."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def take(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position.

    A document appears once for every pass that takes at least half of its words; documents without words and
    those not taken are left out. Rows equal in id and text appear equally often, by their mean. All columns
    stay as they are.
    """
    planned = mix(docs, **settings)
    passes_taken = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    grouped = planned.groupBy(F.col("doc_id").alias("_mix_id"), F.col("_text").alias("_mix_text")).agg(
        F.round(F.avg(passes_taken)).cast("int").alias("_mix_passes"), F.any_value("positions").alias("_mix_positions")
    )
    # Of rows that are equal in all, one's positions serve for all.
    wanted = cut_lineage(grouped.filter(F.col("_mix_passes") > 0))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row")
    keyed = docs.select(row, F.col("doc_id").alias("_mix_own_id"), text_key(whole_text()).alias("_mix_text"))
    joined = keyed.join(wanted, F.col("_mix_own_id").eqNullSafe(F.col("_mix_id")) & (keyed["_mix_text"] == wanted["_mix_text"]))
    number = F.explode(F.sequence(F.lit(1), F.col("_mix_passes"))).alias("_mix_number")
    spread = joined.select("_mix_row", "_mix_positions", number)
    place = F.coalesce(F.try_element_at("_mix_positions", F.col("_mix_number")), F.lit(1.0))
    return spread.orderBy(place, F.col("_mix_row.doc_id")).select("_mix_row.*")
