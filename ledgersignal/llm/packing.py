"""Best-fit packing of tokenised documents into sequences, planned over a histogram of lengths.

A plan needs only how many pieces have each length. Best fit by decreasing length runs over these counts:
equally full sequences are one range of sequence numbers, and a length is put into whole ranges at once. The
plan is a list of ranges of slots, whose size depends on the capacity and not on the number of documents.
Pieces are numbered within their length and take the slot of their number.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersignal.llm.common import stored
from ledgersignal.operators.ranking import running_totals

CAPACITY = 1024
#: Token ids that a task holds before it hands its pieces on.
HELD_IDS = 2_000_000
#: Copies of a row that are made from one array.
COPY_BLOCK = 4_096

# The end token, and the pattern by which the byte-level vocabulary cuts texts into words.
END = 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Slots(NamedTuple):
    """Slots for the pieces of one length numbered ``rank`` to ``rank + n - 1``.

    ``per`` of them go one behind the other into each sequence, from ``sequence`` and ``offset`` on.
    """

    length: int
    rank: int
    n: int
    per: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best fit by decreasing length, as if piece by piece, over counts of lengths from 1 to ``capacity``.

    A piece goes to the fullest sequence that has room for it, else to a new one. A sequence just chosen is the
    fullest with room until it has none, so a range of equally full sequences takes ``room // length`` pieces
    each. Every step uses up a range or a length, at most halves the room of a range, and splits off at most two
    ranges per length: there are at most 13 slot ranges per length and halving, whatever the counts.
    """
    out: list[Slots] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, sequences)
    rooms: list[int] = []
    sequences = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                new = -(-left // (capacity // length))
                add(capacity, sequences, new)
                sequences += new
                continue
            room = rooms[i]
            first, n = ranges[room].pop()
            if not ranges[room]:
                del rooms[i]
            per = room // length
            used = min(n, left // per)
            if not used:
                used, per = 1, left
            out.append(Slots(length, rank, used * per, per, first, capacity - room))
            add(room - per * length, first, used)
            add(room, first + used, n - used)
            rank += used * per
            left -= used * per
    return out


def load_ranks(tokenizer_file: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte strings with their ids, and special tokens with theirs, of a byte-level tokenizer file.

    The file writes bytes as printable characters: those that print stand for themselves, the others are
    numbered from 256 on. Merges are ranked as their results are numbered.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        read = json.load(f)
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in prints}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
    special = {t["content"]: t["id"] for t in read["added_tokens"]}
    return {bytes(byte_of[c] for c in w): i for w, i in read["model"]["vocab"].items() if w not in special}, special


def default_tokenizer(spark: SparkSession) -> str:
    """The tokenizer file named by ``ledgersignal.bpe_tokenizer``, or the public one of the installed package."""
    configured = spark.conf.get("ledgersignal.bpe_tokenizer", "")
    if configured:
        return configured
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def cut(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of the token ids of every whole text, each ended by ``end``.

    Only documents longer than ``capacity`` are cut; all their pieces but the first are full. ``ids`` are
    little-endian unsigned 32-bit numbers. Null and empty texts have the end alone. Repeated rows give repeated
    pieces; other columns are not read; an empty table gives no rows. One scan, no shuffle; the vocabulary,
    whose size the file fixes, is read on the driver and sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer_file))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, special = sent.value
        encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            held = 0
            for row, text in enumerate(batch["text"].fillna("")):
                ids = np.append(encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), end).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(row, p, a, b - a, ids[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                held += len(ids)
                if held > HELD_IDS:
                    yield framed(batch, rows)
                    rows, held = [], 0
            if rows:
                yield framed(batch, rows)

    def framed(batch: pd.DataFrame, rows: list[tuple[int, int, int, int, bytes]]) -> pd.DataFrame:
        at, piece, start, length, ids = zip(*rows, strict=True)
        ids_of = batch["doc_id"].iloc[list(at)].reset_index(drop=True)
        return pd.DataFrame({"doc_id": ids_of, "piece": piece, "start": start, "length": length, "ids": ids})

    # Ids that are null would turn whole numbers into fractions in pandas, so they travel as text.
    read = docs.select(F.col("doc_id").cast("string"), "text")
    found = read.mapInPandas(pieces, "doc_id string, piece int, start long, length long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def each_copy(df: DataFrame, n: str, number: str) -> DataFrame:
    """Row ``n`` times, with ``number`` from 0 to n - 1, in arrays of bounded length."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPY_BLOCK))))
    first = F.col("_block") * COPY_BLOCK
    return blocks.withColumn(number, F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col(n)) - 1))).drop("_block")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece; ``pieces`` has ``length`` and any other columns.

    Equal pieces are counted before they are numbered, and numbers within a length come from a layout by
    range, so neither copies nor a common length meet in one task. The driver sees one count per length.
    """
    columns = pieces.columns
    counted = stored(pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    histogram = counted.groupBy("length").agg(F.sum("_n").alias("n"))
    slots = plan({r["length"]: r["n"] for r in histogram.collect()}, capacity)  # a row per length, at most ``capacity``
    kinds = ", ".join(f"_{f} long" for f in Slots._fields)
    table = pieces.sparkSession.createDataFrame(slots, kinds)
    others = [c for c in columns if c != "length"]
    numbered = each_copy(running_totals(counted, ["length"], others, ["_n"]), "_n", "_copy")
    at = numbered.withColumn("_at", F.col("before__n") + F.col("_copy"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_slots"))
    taken = at.join(F.broadcast(table.withColumnRenamed("_n", "_slots")), fits)
    within = F.col("_at") - F.col("_rank")
    sequence = F.col("_sequence") + F.floor(within / F.col("_per"))
    return taken.select(*columns, sequence.alias("sequence_id"), (F.col("_offset") + F.pmod(within, F.col("_per")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids, sequence and offset: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    return place(cut(docs, tokenizer_file, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, length, ids). A sequence has at most as many pieces as tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda have, part: F.concat(have, part["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
