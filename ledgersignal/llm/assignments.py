"""Secret scanning by lexing assignments.

Three base patterns give base spans. Besides, every text is lexed for pairs of a name and a literal, as
source and configuration files write them (``name = "literal"``, ``name: literal``, ``"name": 'literal'``,
``name := ...``, ``name => ...``, ``name: type = ...``, literals joined by ``+``). Names that were given a
literal before are constants; a pair whose value is such a name takes over the literal. A literal is
reported as ``named`` if the target name is sensitive and the literal looks like no placeholder.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersignal.llm.common import small_batches

# Base patterns, and the shortest second group or whole match that counts.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "named")

# How sensitive a target name is, by a word of it or by two words in a row.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "pin": 0.4, "auth": 0.6, "signature": 0.5, "salt": 0.5, "key": 0.4,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0,
    ("secret", "key"): 1.0, ("account", "key"): 0.9, ("connection", "string"): 0.7,
}
PLACEHOLDERS = ("changeme", "example", "placeholder", "your", "dummy", "xxxx", "****", "none", "null", "true", "false", "todo", "redacted")
THRESHOLD = 0.5

OPERATOR = re.compile(r":=|=>|[:=]")
NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*)["']?\]?[ \t]*$""")
TYPED = re.compile(r"""([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]\n]*\])?[ \t]*$""")
LOOK_BACK = 128
VALUE = re.compile(r"""[ \t]*(?:[rbfuRBFU]{0,2}("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|(\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|[A-Za-z0-9+/_.=~@%!-]+))""")
JOINED = re.compile(r"""[ \t]*\+[ \t]*("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_][A-Za-z0-9_]*)""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern, without those that are too short."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)]
    return max([0.0, *pairs, *(SENSITIVE.get(w, 0.0) for w in words)])


def strength(literal: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders and short or spaced literals."""
    low = literal.lower()
    if len(literal) < ASSIGN_CHARS or any(c.isspace() for c in literal) or any(p in low for p in PLACEHOLDERS):
        return 0.0
    counts = Counter(literal)
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    mixed = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return 1.0 if mixed and bits >= 2.5 else 0.6 if bits >= 2.5 else 0.2


def named_spans(text: str) -> list[Span]:
    """Literals given to sensitive names, directly or through constants, in one pass over the operators."""
    known: dict[str, tuple[str, int, int]] = {}
    found = set()
    end = 0
    for op in OPERATOR.finditer(text):
        if op.start() < end:  # inside the literal just read
            continue
        ahead = text[op.end() : op.end() + 2]
        if ahead[:1] == "=" or ahead == "//" or text[op.start() - 1 : op.start()] in ("=", "!", "<", ">", ":"):
            continue
        before = text[max(0, op.start() - LOOK_BACK) : op.start()]
        name = (TYPED.search(before) if op.group() == "=" else None) or NAME.search(before)
        value = VALUE.match(text, op.end())
        if not name or not value:
            continue
        target = name.group(1)
        if value.group(1) is not None:
            literal, start, stop = value.group(1)[1:-1], value.start(1) + 1, value.end(1) - 1
        else:
            token = value.group(2)
            literal, start, stop = known.get(token.strip("${}"), (token, value.start(2), value.end(2)))
        end = value.end() if value.group(1) is not None else end
        while more := JOINED.match(text, max(end, value.end())):
            part = more.group(1)
            literal += part[1:-1] if part[0] in "\"'" else known.get(part, (part,))[0]
            stop, end = (more.end(1) - 1, more.end()) if part[0] in "\"'" else (stop, more.end())
        known[target] = known[target.rsplit(".", 1)[-1]] = (literal, start, stop)
        if sensitivity(target) * strength(literal) >= THRESHOLD:
            found.add((start, 3, stop))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULT = "n_assign long, n_access long, n_hex long, n_named long, base string, spans string"


def scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = base_spans(text)
        taken = [(a, b) for a, k, b in base if k == 0]
        named = [s for s in named_spans(text) if not any(a <= s[0] and s[2] <= b for a, b in taken)] if ":" in text or "=" in text else []
        kinds = Counter(k for _, k, _ in base)
        rows.append((kinds[0], kinds[1], kinds[2], len(named), joined(base), joined(base + named)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_named", "base", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; one scan and no shuffle.

    Null texts count as empty and have no spans. Repeated rows get the same result each. Literals inside a
    base assignment are not reported again. Other columns are not read; an empty table gives no rows.
    """
    find = F.pandas_udf(scan, RESULT)
    found = small_batches(docs).select("doc_id", find(F.coalesce("text", F.lit(""))).alias("_found"))
    return found.select(
        "doc_id", "_found.n_assign", "_found.n_access", "_found.n_hex", F.sha2(F.col("_found.base").cast("binary"), 256).alias("base_sha256"),
        "_found.spans", "_found.n_named",
    )
