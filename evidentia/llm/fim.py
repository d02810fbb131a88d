"""Fill-in-middle transformation: a text's middle units go to its end, behind marks that tell where they came from.

Units are lines (with their line feed) or code points.  A batch's texts lie end to end as UTF-8 and are viewed as 64-bit words: arithmetic
on whole words marks the bytes that end a unit, a population count for each word and its running sum tell how many ends lie before any
place, and the k-th end is found by searching the running sum for its word and then clearing the lower marks within that word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW7, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE, SEVEN, EIGHT, TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 24  # bytes of texts that are worked on at once; a longer text makes a piece of its own


def feeds(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed."""
    x = w ^ FEEDS
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def leads(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point, that is all but 10xxxxxx."""
    return HIGH & ~(w & ~(w << ONE))


def code_point_ends(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte whose next one begins a code point."""
    first = leads(w)
    after = np.append(first[1:], HIGH)
    return ((first >> EIGHT) | (after << TOP)) & HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        marks = self.marks[np.minimum(word, len(self.marks) - 1)] & ((ONE << (byte * EIGHT)) - ONE)
        return self.before[word] + np.bitwise_count(marks)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 1; every k must exist."""
        word = np.searchsorted(self.before, k, side="left") - 1
        marks, left = self.marks[word].copy(), k - self.before[word]
        for _ in range(7):
            more = left > 1
            marks[more] &= marks[more] - ONE
            left -= more
        lowest = marks & (~marks + ONE)
        return word * 8 + (np.bitwise_count(lowest - ONE) >> 3)


def _words(raw: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(raw) // 8 * 8 + 8, np.uint8)
    padded[: len(raw)] = raw
    return padded.view("<u8")


def cuts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, Marks]:
    """For texts at ``starts`` to ``ends`` in ``raw``: how many units each has, the ends before each, and the marks to find them by."""
    w = _words(raw)
    marks = Marks(feeds(w) if unit == "line" else code_point_ends(w))
    before = marks.rank(starts)
    n = marks.rank(ends) - before
    filled = ends > starts
    last = np.zeros(len(starts), np.uint8)
    last[filled] = raw[ends[filled] - 1]
    open_end = filled & (last != 10) if unit == "line" else np.zeros(len(starts), bool)
    return n + open_end, before, marks


def ends_of(k: np.ndarray, n: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, marks: Marks) -> np.ndarray:
    """Where the first k of a text's n units end."""
    out = np.where(k == 0, starts, ends)
    inner = (k > 0) & (k < n)
    out[inner] = marks.select(before[inner] + k[inner]) + 1
    return out


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from seed and id; a null id counts as empty."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with PIECE bytes at most, or a single row."""
    at, held = 0, 0
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    for i, size in enumerate(sizes):
        if i > at and held + size > PIECE:
            yield at, i
            at, held = i, 0
        held += int(size)
    if at < len(texts):
        yield at, len(texts)


def _transformed(ids: list, texts: pa.Array, unit: str, seed: int, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    n, before, marks = cuts(raw, starts, ends, unit)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    low, high = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
    first, second = (ends_of(k, n, starts, ends, before, marks) for k in (low, high))
    points = Marks(leads(_words(raw)))
    at_start, at_first, at_second = points.rank(starts), points.rank(first), points.rank(second)
    whole = raw.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, output, prefix_chars, middle_chars = [], [], [], []
    for i in range(len(ids)):
        text = whole[starts[i] : ends[i]]
        if not text or p in text or s in text or m in text or h[i, 2] % 100 >= fim_percent:
            kind, out = "plain", text
        else:
            a, b, c = whole[starts[i] : first[i]], whole[first[i] : second[i]], whole[second[i] : ends[i]]
            kind = "spm" if h[i, 3] % 100 < spm_percent else "psm"
            out = b"".join((s, c, p, a, m, b) if kind == "spm" else (p, a, s, c, m, b))
        plain = kind == "plain"
        form.append(kind)
        output.append(out)
        prefix_chars.append(None if plain else int(at_first[i] - at_start[i]))
        middle_chars.append(None if plain else int(at_second[i] - at_first[i]))
    made = pa.array(output, pa.binary()).cast(pa.string(), safe=False)
    arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), made]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs(doc_id, text)``.

    A text is cut into n units (``unit``: "line" or "code point") at two places drawn from seed and doc_id.  ``form`` is "psm", "spm", or
    "plain" where the text is null or empty, holds one of the marks, or isn't drawn (``fim_percent``); a plain text is its own output and
    has null prefix_chars and middle_chars.  A null text counts as empty, a null doc_id as an empty number.  Rows that repeat give the
    same result each; an empty table gives an empty result.  Other columns are ignored.  Texts of any length are worked on whole, where
    they lie, without a shuffle.
    """
    if unit not in ("line", "code point"):
        raise ValueError(f"no such unit: {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            ids = batch.column("doc_id")
            for a, b in _slices(texts):
                yield _transformed(ids[a:b].to_pylist(), texts[a:b], unit, seed, fim_percent, spm_percent)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _behind(col: Column, mark: str, until: str | None = None) -> Column:
    """What stands behind a mark, up to the next one."""
    found = F.substring_index(col, mark, -1)
    return F.substring_index(found, until, 1) if until else found


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form.  No mark stands in a text that isn't plain, nor can one arise where the parts meet, as "<" only begins a mark."""
    psm = F.concat(_behind(output, PREFIX, SUFFIX), _behind(output, MIDDLE), _behind(output, SUFFIX, MIDDLE))
    spm = F.concat(_behind(output, PREFIX, MIDDLE), _behind(output, MIDDLE), _behind(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
