"""A recurrent labeller of text blocks: a bidirectional LSTM in numpy.

Each block of a page becomes a vector: its tag path and its words, both hashed to signed random directions, and a few
measures.  One LSTM reads a page's blocks from the first to the last, one from the last to the first, and each block is
judged from both states, so from the whole page.
"""

from __future__ import annotations

import zlib

import numpy as np

from evidentia.llm.html_blocks import Block

PATH_DIM, WORD_DIM, HIDDEN = 96, 24, 24
DIM = PATH_DIM + WORD_DIM + 6
WORDS = np.random.RandomState(1).choice((-1.0, 1.0), (4096, WORD_DIM)).astype(np.float32) / np.sqrt(WORD_DIM)  # by hash
_DIRECTIONS: dict[tuple[str, int], np.ndarray] = {}


def direction(name: str, dim: int) -> np.ndarray:
    """The random direction that a name is hashed to."""
    key = (name, dim)
    if key not in _DIRECTIONS:
        if len(_DIRECTIONS) > 100_000:
            _DIRECTIONS.clear()
        _DIRECTIONS[key] = np.random.RandomState(zlib.crc32(name.encode()) & 0xFFFFFFFF).choice((-1.0, 1.0), dim) / np.sqrt(dim)
    return _DIRECTIONS[key]


def features(page: list[Block]) -> np.ndarray:
    """A row of DIM numbers for each block."""
    out = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        for j, name in enumerate(reversed(b.path)):  # the innermost names weigh most, so that an aside within an article shows
            out[i, :PATH_DIM] += direction(name, PATH_DIM) * max(0.4, 0.85**j) * 1.5
        words = b.text.lower().encode("utf-8", "replace").split(b" ")
        at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % len(WORDS)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = WORDS[at].sum(0) / len(words) ** 0.5
        n = len(b.text)
        out[i, -6:] = np.log1p(n) / 6, b.linked / n, sum(map(b.text.count, ".,;:!?")) / n * 10, i / len(page), n < 30, len(b.path) / 10
    return out


class Labeller:
    """Weights and passes of the network; ``forward`` returns for each block the log-odds that it is main text."""

    def __init__(self, seed: int = 0):
        r = np.random.RandomState(seed)
        glorot = lambda *s: (r.normal(size=s) * np.sqrt(1.0 / s[0])).astype(np.float32)
        self.w = {f"x{d}": glorot(DIM, 4 * HIDDEN) for d in "fb"} | {f"h{d}": glorot(HIDDEN, 4 * HIDDEN) for d in "fb"}
        self.w |= {f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN) for d in "fb"} | {"o": glorot(2 * HIDDEN, 1), "p": np.zeros(1, np.float32)}
        self.w["s"] = np.zeros((DIM, 1), np.float32)  # from a block's own vector straight to its odds, beside what the states add

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """States over time (steps x pages x HIDDEN) of one direction; ``x`` in reading order, mask 0 behind a page's end."""
        w, bias, steps = self.w["h" + d], self.w["c" + d], []
        h, c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        into, out = x @ self.w["x" + d] + bias, np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            z = into[t] + h @ w
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            tanh = np.tanh(c_new)
            if keep:
                steps.append((h, c, i, f, o, g, tanh, m))
            h, c = o * tanh * m, c_new
            out[t] = h
        return out, steps

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        back = reversed_pages(x, mask)
        hf, sf = self._run(x, mask, "f", keep)
        hb, sb = self._run(back, mask, "b", keep)
        both = np.concatenate([hf, reversed_pages(hb, mask)], axis=2)
        odds = (both @ self.w["o"])[:, :, 0] + (x @ self.w["s"])[:, :, 0] + self.w["p"]
        return (odds, (back, sf, sb, both)) if keep else odds

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the blocks that the mask shows."""
        odds, (back, sf, sb, both) = self.forward(x, mask, True)
        d_odds = ((1 / (1 + np.exp(-odds)) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        grads = {"o": (both * d_odds).sum((0, 1))[:, None], "p": d_odds.sum((0, 1)), "s": (x * d_odds).sum((0, 1))[:, None]}
        d_both = d_odds * self.w["o"][:, 0]
        for d, steps, seen, d_h in (("f", sf, x, d_both[:, :, :HIDDEN]), ("b", sb, back, reversed_pages(d_both[:, :, HIDDEN:], mask))):
            w, dh, dc = self.w["h" + d], 0.0, 0.0
            dz_all, h_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros((*x.shape[:2], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, g, tanh, m = steps[t]
                dh = (d_h[t] + dh) * m
                dc = (dc + dh * o * (1 - tanh**2)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[t], h_all[t] = dz, h
                dh, dc = dz @ w.T, dc * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads |= {"x" + d: seen.reshape(-1, DIM).T @ flat, "h" + d: h_all.reshape(-1, HIDDEN).T @ flat, "c" + d: flat.sum(0)}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 6, rate: float = 0.004, batch: int = 32, seed: int = 0) -> Labeller:
        """The direct weights alone first, so that each block's own tags tell all they can; then everything, by Adam over batches of pages of
        like length."""
        self._direct(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]))
        r, moments, step = np.random.RandomState(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}, 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in range(rounds):
            for b in r.permutation(len(batches)):
                own = [pages[i] for i in batches[b]]
                x, mask = padded([p[0] for p in own])
                y = padded([p[1][:, None] for p in own])[0][:, :, 0]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    a, v = moments[name]
                    a += 0.1 * (g - a)
                    v += 0.001 * (g * g - v)
                    self.w[name] -= rate * (0.3 if k >= rounds - 2 else 1) * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _direct(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1) -> None:
        """Logistic regression of blocks by themselves."""
        w, moments = np.concatenate([self.w["s"][:, 0], self.w["p"]]), np.zeros((2, x.shape[1] + 1), np.float32)
        own = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        for k in range(1, steps + 1):
            g = own.T @ (1 / (1 + np.exp(-(own @ w))) - y) / len(own) + 1e-4 * w
            moments[0] += 0.1 * (g - moments[0])
            moments[1] += 0.001 * (g * g - moments[1])
            w -= rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.999**k)) + 1e-8)
        self.w["s"], self.w["p"] = w[:-1, None].astype(np.float32), w[-1:].astype(np.float32)
        self.w["o"] *= 0.1  # what the states say begins small

    def label(self, pages: list[np.ndarray], batch: int = 64, most: int = 1 << 14) -> list[np.ndarray]:
        """For each page, which blocks are main text.  Pages of like length go together, as long as they have ``most`` blocks with the padding."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        own: list[int] = []
        for n, i in enumerate(order):
            own.append(i)
            after = order[n + 1] if n + 1 < len(order) else None
            if after is None or len(own) == batch or (len(own) + 1) * len(pages[after]) > most:
                odds = self.forward(*padded([pages[j] for j in own]))
                for k, j in enumerate(own):
                    out[j] = odds[: len(pages[j]), k] > 0
                own = []
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps x pages x numbers, and the mask of what is there."""
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def reversed_pages(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Every page's steps from its last to its first; what is behind the end stays."""
    n, t = mask.sum(0).astype(int), np.arange(len(x))[:, None]
    at = np.where(t < n, n - 1 - t, t)
    return x[at, np.arange(x.shape[1])[None, :]]
