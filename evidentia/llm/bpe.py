"""Byte-level BPE by dynamic programming over prefixes.

For a byte string, every prefix has exactly one last token in its encoding: the one that is compatible with the last
token of the prefix before it.  Two tokens are compatible if the merges leave their concatenation as those two.  A
table with the last token of every prefix therefore encodes the string (walk back from the end), is extended by
appended bytes without touching what it has, and after an edit is recomputed only until it agrees with itself again.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import id_in, id_out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens, their ranks and which pairs of them are compatible."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 2_000_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.remember = remember
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.finder = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.finder.add_word(t.decode("latin-1"), (i, len(t)))
        self.finder.make_automaton()

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Plain BPE: merge the adjacent pair of least rank, leftmost first, while more than ``down_to`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joined; None for a single byte or what merges don't make."""
        if token not in self.halves:
            parts = self.merged(self.tokens[token], 2)
            whole = len(parts) == 2 and parts[0] + parts[1] in self.ranks
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        """Whether merges make the token from its bytes."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > self.remember:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, x: int, y: int) -> bool:
        """Goes back in time from the finished tokens, undoing the merge of higher rank on either side of the border.

        The border is crossed if what lies on both its sides at some time could merge before either side's next merge.
        Of two equal ranks the one further left comes first.
        """
        next_x = next_y = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and across < next_x and across <= next_y:
                return False
            at_x, at_y = self.split(x), self.split(y)
            if at_x is None and at_y is None:
                return True
            if at_y is None or (at_x is not None and x > y):
                next_x, x = x, at_x[1]
            else:
                next_y, y = y, at_y[0]


class PrefixTable:
    """The last token of each prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _fill(self, upto: int) -> None:
        """Adds the entries up to a length: of the tokens that end at a byte, the one that fits what is before it."""
        v, last, at = self.v, self.last, len(self.last)
        base = max(0, at - v.longest)
        last += [-1] * (upto - at)
        pairs = v.pairs
        for end, (token, length) in v.finder.iter(self.data[base:upto].decode("latin-1")):
            end += base
            if end < at or last[end] >= 0:
                continue
            start = end - length
            if start < 0:
                fits = v.reachable(token)
            else:
                fits = pairs.get((last[start], token))
                if fits is None:
                    fits = v.compatible(last[start], token)
            if fits:
                last[end] = token

    def restart(self, keep: int, data: bytes) -> None:
        """Become the table of ``data``, which agrees with the present string in its first ``keep`` bytes."""
        self.data = data
        del self.last[keep:]
        self._fill(len(data))

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; returns how many entries were computed anew.

        An entry depends on the ``longest`` bytes and entries before it, so once that many entries behind the edit
        equal the old ones, so do all that follow.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        same = done = 0
        for at in range(start + 1, len(self.data) + 1):
            if same >= self.v.longest and at > start + len(new) + self.v.longest:
                self.last += old[at - 1 - shift :]
                break
            self._fill(at)
            done += 1
            same = same + 1 if at > start + len(new) and old[at - 1 - shift] == self.last[-1] else 0
        return done

    def tokens(self) -> list[int]:
        """The encoding of the whole string."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece as the tiktoken library does, with a bounded memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 500_000):
        self.v = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.remember = remember
        self.seen: dict[str, bytes] = {}
        self.by_id = [self.v.tokens.get(i, b"") for i in range(max(self.v.tokens) + 1)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces: in order, so that one shares the table of the prefix that it has in common with the last."""
        ranks, by_id, seen, table, before = self.v.ranks, self.by_id, self.seen, PrefixTable(self.v), b""
        for data, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            whole = ranks.get(data)
            if whole is not None:
                seen[piece] = whole.to_bytes(4, "little")
                continue
            common = next((i for i, (x, y) in enumerate(zip(before, data, strict=False)) if x != y), min(len(before), len(data)))
            table.restart(common, data)
            before, last, at, ids = data, table.last, len(data), []
            while at:
                token = last[at - 1]
                ids.append(token)
                at -= len(by_id[token])
            seen[piece] = struct.pack(f"<{len(ids)}I", *reversed(ids))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = list(map(self.pattern.findall, texts))
        if len(self.seen) > self.remember:
            self.seen.clear()
        self.learn(set().union(*split).difference(self.seen))
        found = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(found, x)), "<u4") for x in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


class EncodedText:
    """A text with its pieces, which appends and edits re-encode near the change only.

    A piece depends on the text from its own start on; a match that ends well before a change is not affected.  Four
    pieces before it are split anew, as a match may have looked a few characters ahead.
    """

    BACK = 4

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text = encoder, text
        self.spans = [m.span() for m in encoder.pattern.finditer(text)]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start:end``; returns the number of pieces split anew."""
        shift, old = len(new) - (end - start), self.spans
        self.text = self.text[:start] + new + self.text[end:]
        first = next((i for i, (_, b) in enumerate(old) if b >= start), len(old))
        keep = max(0, first - self.BACK)
        at, out, ends = old[keep - 1][1] if keep else 0, [], {a: i for i, (a, _) in enumerate(old) if a >= end}
        while (m := self.e.pattern.search(self.text, at)) is not None:
            if m.start() >= start + len(new) and m.start() - shift in ends:
                out += [(a + shift, b + shift) for a, b in old[ends[m.start() - shift] :]]
                break
            out.append(m.span())
            at = m.end()
        self.spans = old[:keep] + out
        return len(out)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> np.ndarray:
        pieces = [self.text[a:b] for a, b in self.spans]
        self.e.learn(set(pieces).difference(self.e.seen))
        return np.frombuffer(b"".join(map(self.e.seen.__getitem__, pieces)), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(package: str, name: str) -> Encoder:
    """The encoder of a vocabulary file, made once in each Python worker."""
    if (package, name) not in _ENCODERS:
        files = importlib.import_module(package)
        _ENCODERS[package, name] = Encoder(load_ranks(files.path(name)), files.PATTERN)
    return _ENCODERS[package, name]


def encode_documents(
    docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", package: str = "public_tokenizers", with_ids: bool = False
) -> DataFrame:
    """``(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256)``, with ``ids`` as array<long> where asked for.

    Every row of ``docs(doc_id, text)`` gives one row; a null text counts as empty and has no tokens.  Other columns
    are ignored.  Rows are worked on where they lie: no shuffle.
    """
    schema = "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(package, name)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                texts = [x if isinstance(x, str) else "" for x in part["text"]]
                for doc_id, ids in zip(part["doc_id"].array, encoder.encode_all(texts), strict=True):
                    back = encoder.decode(ids)
                    row = (doc_id, len(ids), len(back), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
                    out.append((*row, ids.astype(np.int64)) if with_ids else row)
                made = pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
                yield made

    texts = docs.select(id_in(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, schema).withColumn("doc_id", id_out(F.col("doc_id")))
