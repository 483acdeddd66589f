"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token is found from left to right; what it is up to a prefix depends on the
prefix alone. Distinct pre-tokens are therefore put in a trie, each node of which gets its forward score and
token count once, and the nodes where pre-tokens end give the counts. Sorting the pre-tokens walks the trie
in depth-first order, so only the path to the current node is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgersignal.llm.common import small_batches

#: Pre-tokens whose counts a task keeps at most; beyond, it starts anew. This bounds memory, not results.
KEPT_PRETOKENS = 400_000
MARK = "▁"  # Fixed value: stands for the space before a pre-token.

Vocabulary = tuple[dict[str, float], float, int]  # log probabilities, that of one byte of an unknown character, longest piece


def load_vocabulary(model_file: str) -> Vocabulary:
    """Pieces of a public vocabulary file with log probabilities.

    The file gives an order of pieces, not probabilities; they are taken to fall as 1 / rank (Zipf's law).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    scores = {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(ids, 1)}
    return scores, min(scores.values()) - 1.0, max(map(len, scores))


def trie_counts(pretokens: Iterable[str], vocabulary: Vocabulary) -> Iterator[tuple[str, int, float]]:
    """(pre-token, tokens, score) for distinct pre-tokens, each shared prefix scored once.

    Of equally good segmentations the one with fewer tokens counts.
    """
    scores, unknown, longest = vocabulary
    look = scores.get
    path: list[tuple[float, int]] = [(0.0, 0)]  # forward score and negated token count of each prefix
    last = ""
    for word in sorted(pretokens):
        limit = min(len(word), len(last))
        shared = 0
        while shared < limit and word[shared] == last[shared]:
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "replace"))
            score, tokens = path[end - 1]
            best = (score + unknown * n_bytes, tokens - n_bytes)
            for start in range(max(0, end - longest), end):
                p = look(word[start:end])
                if p is not None:
                    score, tokens = path[start]
                    if (score + p, tokens - 1) > best:
                        best = (score + p, tokens - 1)
            path.append(best)
        last = word
        yield word, -path[-1][1], path[-1][0]


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of ``docs``: pre-tokens (words between white space), tokens, and the log score of the text.

    One scan, no shuffle: a task puts the pre-tokens of its texts that it has not seen into a trie, batch by
    batch. Null, empty and white texts have no tokens. Repeated rows get the same counts. Other columns are
    not read; an empty table gives no rows. The vocabulary is read on the driver and sent to the tasks; its
    size is fixed by the file.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            n_pre, n_tok, score = [], [], []
            rows = iter(batch["text"].fillna(""))
            while texts := [t.split() for t in islice(rows, 64)]:
                new = {w for words in texts for w in words}
                if len(known) > KEPT_PRETOKENS:
                    known = {}
                new.difference_update(known)
                for word, tokens, value in trie_counts([MARK + w for w in new], vocabulary.value):
                    known[word[1:]] = (tokens, value)
                for words in texts:
                    found = [known[w] for w in words]
                    n_pre.append(len(words))
                    n_tok.append(sum(f[0] for f in found))
                    score.append(math.fsum(f[1] for f in found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_pretokens": n_pre, "n_tokens": n_tok, "log_score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_pretokens long, n_tokens long, log_score double")


def default_model(spark: SparkSession) -> str:
    """The vocabulary file named by ``ledgersignal.tokenizer``, or the public one of the installed package."""
    configured = spark.conf.get("ledgersignal.tokenizer", None)
    if configured:
        return configured
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))
