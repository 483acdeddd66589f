"""Spelling variants: words one edit apart, found by sorting permuterm rotations.

A word ``xay`` with its end marked has the rotation ``y$xa``, which begins behind the letter ``a`` and ends with
it. All words that differ in that letter alone share the rotation's beginning ``y$x``, and the word without the
letter has ``y$x`` as a whole rotation. With every rotation entered once whole and once without its last
letter, words one edit apart are those with equal entries. Such a group has a word per letter of the alphabet
and the word without the letter at most, however many words there are, so groups are scanned as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersignal.llm.common import stored
from ledgersignal.operators.ranking import ordinal_rank
from ledgersignal.session import cut_lineage

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Every so manieth (document, word) by its checksum loses a letter.
TYPO_EVERY = 199

#: Bytes of text that are split at once, and bytes of words that a task counts before it hands counts on.
PIECE_BYTES, HELD_BYTES = 4_000_000, 24_000_000
#: Rotations of more letters are entered by checksums of their two parts, so long words take room in proportion.
SPELLED = 64
PRIME, BASES = 2**61 - 1, (1_000_003, 754_974_721)

#: Latin-1 bytes of words stay, A to Z in small letters, all others become spaces.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of letters from A to Z and U+00C0 to U+00FF as Latin-1, piece by piece of the text."""
    # Other characters become question marks, one for one.
    flat = text.encode("latin-1", "replace").translate(_KEEP)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE_BYTES)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def words_of(doc_id: str, text: str, shortest: int = MIN_LENGTH, typo_every: int = TYPO_EVERY) -> Counter[bytes]:
    """Words of ``shortest`` letters and more with their occurrences, after letters were taken out."""
    runs: Counter[bytes] = Counter()
    for piece in runs_of(text):
        runs.update(w for w in piece if len(w) >= shortest)
    if not typo_every:
        return runs
    start = zlib.crc32(f"{doc_id}:".encode())
    changed = []
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % typo_every == 0:
            changed.append((run, h % len(run), n))
    made: Counter[bytes] = Counter()
    for run, at, n in changed:
        del runs[run]
        if len(run) > shortest:
            made[run[:at] + run[at + 1 :]] += n
    runs.update(made)
    return runs


def count_words(docs: DataFrame, min_count: int = MIN_COUNT, shortest: int = MIN_LENGTH, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n) over all texts. Tasks add up counts before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        held = 0

        def framed() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = words_of(doc_id, text, shortest, typo_every)
                before = len(total)
                total.update(found)
                # New words, as many as the text can have brought, at their average length.
                held += (len(total) - before) * (60 + sum(map(len, found)) // max(1, len(found)))
                if held > HELD_BYTES:
                    yield framed()
                    total, held = Counter(), 0
        if total:
            yield framed()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = read.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def entries(word: str) -> list[tuple[str, str, bool]]:
    """(rotation or its beginning, last letter or "", whether the letter begins a run of equal ones).

    A word with a letter taken out of a run of equal letters is the same whichever of them goes; only the first
    is marked.
    """
    n = len(word)
    part = word if n <= SPELLED + 1 else ""
    sums = [_sums(word, base) for base in BASES] if n > SPELLED else []

    def name(before: int, behind: int) -> str:
        """The rotation that has ``word[behind:]``, the end mark, and ``word[:before]``."""
        if before + n - behind <= SPELLED:
            return part[behind:] + "$" + part[:before]
        return ":".join([str(before), str(n - behind), *(f"{front[before]:x}.{back[behind]:x}" for front, back in sums)])

    whole = [(name(i, i), "", False) for i in range(n + 1)]
    return whole + [(name(i, i + 1), c, i == 0 or word[i - 1] != c) for i, c in enumerate(word)]


def _sums(word: str, base: int) -> tuple[list[int], list[int]]:
    """Polynomial checksums of all beginnings and all ends of a word."""
    front, back, power = [0], [0], 1
    for c in word:
        front.append((front[-1] * base + ord(c)) % PRIME)
    for c in reversed(word):
        back.append((back[-1] + ord(c) * power) % PRIME)
        power = power * base % PRIME
    return front, back[::-1]


def rotations(words: DataFrame) -> DataFrame:
    """Entries of all rotations: (entry, letter, first, id, n) of (id, word, n)."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[tuple[str, str, bool, int, int]] = []
            for i, word, n in zip(batch["id"], batch["word"], batch["n"], strict=True):
                made += [(*e, i, n) for e in entries(word)]
                if len(made) > 100_000:
                    yield pd.DataFrame(made, columns=["entry", "letter", "first", "id", "n"])
                    made = []
            if made:
                yield pd.DataFrame(made, columns=["entry", "letter", "first", "id", "n"])

    return words.mapInPandas(turn, "entry string, letter string, first boolean, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """Per word with near words: (id, n_near, near_n, near_id), the last two of the most frequent near word.

    ``words`` has (id, word, n), ids in the order of words. Rotations are sorted by entry; a group of equal
    entries has a word per letter and one without it. Two words with a letter each are near; a word with a
    letter and the one without it are near, and counted where the letter is the first of its run.
    """
    same = Window.partitionBy("entry").orderBy("letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = rotations(words).withColumn("_size", F.count(F.lit(1)).over(same)).filter("_size > 1")
    groups = shared.groupBy("entry").agg(F.collect_list(F.struct("letter", "first", "id", "n")).alias("all"))

    def near(me: Column) -> Column:
        def other(x: Column) -> Column:
            both = (me["letter"] != "") & (x["letter"] != "") & (me["letter"] != x["letter"])
            return both | ((me["letter"] == "") & x["first"]) | (me["first"] & (x["letter"] == ""))

        return F.transform(F.filter("all", other), lambda x: F.struct((-x["n"]).alias("less"), x["id"].alias("id")))

    found = groups.select(F.explode(F.transform("all", lambda me: F.struct(me["id"].alias("id"), near(me).alias("near")))).alias("_m"))
    scanned = found.select("_m.id", F.size("_m.near").alias("n_near"), F.array_min("_m.near").alias("best"))
    joined = scanned.groupBy("id").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best")).filter("n_near > 0")
    return joined.select("id", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.id").alias("near_id"))


def follow(forms: DataFrame, most: int, factor: int = FACTOR) -> DataFrame:
    """(id, root) of (id, form): forms followed to the last, in steps of double length.

    A form is ``factor`` times as frequent as its word, so the largest count bounds the length of a chain.
    """
    longest, reach = 1, most
    while reach >= factor:
        longest, reach = longest + 1, reach // factor
    roots = forms.select("id", F.col("form").alias("root"))
    step = 1
    while step < longest:
        roots = cut_lineage(roots)
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("_further"))
        roots = roots.join(further, "root", "left").select("id", F.coalesce("_further", "root").alias("root"))
        step *= 2
    return roots


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their occurrences (word, n).

    The form of a word is its near word with the largest count (of equals the smallest by code points), if that
    is ``factor`` times the word's; the root is what forms lead to, the word itself if it has none. Words
    without near words have n_near 0. An empty table gives no rows.
    """
    known = stored(ordinal_rank(words.select("word", "n"), ["word"], "id"))
    near = cut_lineage(neighbours(known.select("id", "word", "n")))
    judged = known.join(near, "id", "left").withColumn("_form", F.when(F.col("near_n") >= factor * F.col("n"), F.col("near_id")))
    forms = judged.filter("_form IS NOT NULL").select("id", F.col("_form").alias("form"))
    most = known.agg(F.max("n")).first()[0] or 0
    roots = follow(forms, most, factor)
    named = known.select(F.col("id").alias("_form"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = known.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    out = judged.join(named, "_form", "left").join(roots, "id", "left").join(ends, "root", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of all whole texts, letters taken out of every 199th (document, word).

    Null texts have no words; a null id is written as nothing; repeated rows count again. Other columns are not
    read. Texts are split in pieces at the end of a word; long words are entered by checksums.
    """
    return group_variants(count_words(docs))
