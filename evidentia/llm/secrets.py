"""Secret scans: patterns, and literals that reach names which promise a secret.

``assignments`` lexes source and configuration syntax into pairs of names and literals and propagates constants: ``k = "..."`` followed by
``password = k`` marks the literal at k.  Literals are scored by their target names and by how random they look.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.assignments import Reader
from evidentia.llm.common import id_out
from evidentia.llm.spans import Span, identified, masked, sha256, written

# The kinds of base spans in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Words within a name and what each adds to the score of a literal.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "auth": 2, "authorization": 2, "private": 1, "access": 1, "api": 1, "key": 1, "client": 0, "signing": 1, "encryption": 1,
}
LEAST_SCORE = 4.0
LEAST_PROMISE = 2

PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[Span]:
    """Spans of the three kinds, by start and then kind: leftmost within a kind, failing matches dropped."""
    low, out = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "key")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def sensitivity(name: str) -> float:
    """How much a name promises a secret: the weights of its words (snake, kebab and camel case; plural ones too), and of two neighbours of
    one member in one.  What has blanks is no name."""
    if any(c.isspace() for c in name):
        return 0
    found = set()
    for member in name.split("."):
        parts = [x.lower() for x in PARTS.findall(member)]
        for x in (*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))):
            found.add(x if x in SENSITIVE else x.removesuffix("s"))
    return sum(SENSITIVE.get(x, 0) for x in found)


_REST = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
_STRONG = [w.encode() for w, x in SENSITIVE.items() if x >= LEAST_PROMISE]
_WEAK = [w.encode() for w, x in SENSITIVE.items() if 0 < x < LEAST_PROMISE]


def may_promise(text: str) -> bool:
    """Whether any name of the text can reach LEAST_PROMISE: the words that it would need all stand in the text's ASCII letters and digits."""
    low = text.encode("utf-8", "surrogatepass").translate(None, _REST).lower()
    return any(w in low for w in _STRONG) or sum(w in low for w in _WEAK) > 1


def randomness(literal: str) -> float:
    """Points for length, bits per character and kinds of characters; words and paths get few."""
    n = len(literal)
    if n < 8 or re.search(r"\s", literal) or literal.startswith(("http://", "https://", "${", "{{", "/", "$(")):
        return -10.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(x, literal)) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]"))
    return (n >= 12) * 0.5 + (bits >= 3) * 1.0 + (kinds - 1) * 0.75 + (-2.0 if literal.isalpha() and literal.islower() else 0.0)


def literal_spans(text: str) -> list[Span]:
    """Literals that reach sensitive names, as spans of kind ``literal`` (without their quotes), by start."""
    if not may_promise(text):
        return []
    reader, out = Reader(text, lambda name: sensitivity(name) >= LEAST_PROMISE), set()
    for pair in reader.pairs:
        promised = sensitivity(pair.name)
        parts = reader.literals(pair)
        every = [x for found in parts for x in found]
        alone = [[x] for x in every] if len(every) > 1 else []
        for own in [every, *alone]:  # parts of one value, or elements of a list, of any number
            if own and promised + randomness("".join(text[a:b] for a, b in own)) >= LEAST_SCORE:
                out |= {("literal", a, b) for a, b in own if a < b}
    return sorted(out, key=lambda s: s[1:])


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    ``spans`` has the base spans and the literals found by target names, by start.  Null and empty texts have none; rows that repeat give
    the same result each.  Texts of any length are read whole, one by one where they lie, without a shuffle; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, version in zip(batch["doc_id"].array, batch["text"], batch["version"], strict=True):
                text = text if isinstance(text, str) else ""
                spans = base_spans(text)
                n, base = Counter(k for k, _, _ in spans), written(spans)
                every = sorted(spans + literal_spans(text), key=lambda s: (s[1], (*KINDS, "literal").index(s[0])))
                out.append((doc_id, version, *(n[k] for k in KINDS), sha256(base), written(every)))
            yield pd.DataFrame(out, columns=["doc_id", "version", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    found = identified(docs).mapInPandas(run, "doc_id long, version long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumn("doc_id", id_out(F.col("doc_id")))


def redacted(text: str) -> str:
    """A text with its secrets replaced by ``[SECRET]``."""
    return masked(text, base_spans(text) + literal_spans(text), dict.fromkeys((*KINDS, "literal"), "[SECRET]"))
