"""Spans of text: what the scans of personal data and of secrets share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import id_in

#: (kind, start, end) in code points, end exclusive.
Span = tuple[str, int, int]


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), text and ``version``, a hash that tells texts apart that share a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(id_in(F.col("doc_id")).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def masked(text: str, spans: Iterable[Span], marks: dict[str, str]) -> str:
    """The text with each span replaced by its kind's mark; spans that overlap merge under the first one's mark."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], marks.get(kind, f"[{kind.upper()}]")]
        at = b
    return "".join(out) + text[at:]
