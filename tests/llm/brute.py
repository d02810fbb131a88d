"""Plain versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = [x.encode().lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts: dict, k: int, num: int = 80, den: int = 100) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    at, both, up = defaultdict(list), defaultdict(int), {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for own in at.values():
        for n, b in enumerate(own):
            for a in own[:n]:
                both[a, b] += 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def dedup_lines(rows: list[tuple]) -> dict:
    """{doc_id: text} for rows (doc_id, text) with unique ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        solid = [j for j, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        strip = [lines[j].strip(" \t\x0b\x0c\r") for j in solid]
        n = [len(WORD.findall(x)) for x in strip]
        for k in range(len(solid)):
            for size in (1, 2, 3):
                if k + size > len(solid) or size == 1 and n[k] <= 50 or size == 2 and (max(n[k], n[k + 1]) > 50 or n[k] + n[k + 1] <= 50):
                    continue
                key = tuple(strip[k : k + size])
                if key in seen:
                    gone |= set(solid[k : k + size])
                seen.add(key)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text
    return out


def quality(text: str | None) -> dict:
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + j for own in at.values() if len(own) > 1 for i in own for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
