"""Main text of web pages.

The labeller is trained on a bounded sample of the pages themselves: semantic elements (article, nav, footer ...) tell
which of their texts are main and which aren't, and these texts are set anew into layouts of many kinds, with tags,
class names, boilerplate of all sorts and reader comments in other places, so that the network learns to judge by words
and context as well as by tags.  Where pages have no semantic elements, their longer blocks that aren't links are the texts to set.
Extraction then labels every block of every page.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.block_labels import PATH_DIM, WORD_DIM, Labeller, features
from evidentia.llm.common import id_in, id_out
from evidentia.llm.html_blocks import Block, blocks

SAMPLE = 240  # pages that the labeller is trained on, at most
LARGEST = 200_000  # characters of a page that may be in the sample
LONGEST = 60  # blocks of a page that training reads; extraction reads all
LAYOUTS = 3  # layouts made of each of them
BLOCKS = 20_000  # of the pages that are labelled together, the last one's aside
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu"))
TELLING = OTHER_TAGS | {"header"}

# Names that pages give to their parts.
WRAPS = (
    ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".article", ".body"), ("div", ".post", ".content"), ("section", ".story"),
    ("div", ".entry", ".content"), ("div", ".main", "article"), ("div", ".container", "article"), ("div", ".text"), ("div", ".page", "div", ".article"),
)
TOP = (
    ("nav", "ul", "li"), ("nav",), ("nav", "p"), ("header",), ("header", "nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("ul", ".navbar", "li"), ("div", ".header"), ("div", ".topbar"),
    ("div", ".site", ".header", "p"), ("div", ".breadcrumb"), ("div", ".nav"), ("div", ".cookie", ".notice", "p"), ("div", ".banner"), ("div", ".notice"),
    ("div", ".consent"), ("div", ".alert"), ("header", "h1"), ("header", "p"), ("div", ".cookies"), ("div", ".login"), ("div", ".search"),
)
SIDE = (
    ("aside",), ("aside", "p"), ("aside", "ul", "li"), ("div", ".sidebar"), ("div", ".sidebar", "ul", "li"), ("div", ".widget"), ("div", ".related", "ul", "li"), ("div", ".ad"),
    ("div", ".ads"), ("div", ".advert"), ("div", ".advertisement"), ("div", ".promo"), ("div", ".sponsored"), ("section", ".related"), ("form",), ("form", "p"), ("form", ".newsletter"),
    ("form", "label"), ("div", ".newsletter"), ("div", ".share"), ("div", ".social"), ("div", ".subscribe"), ("aside", ".sidebar", "h3"), ("div", ".popup"), ("div", ".tags"),
)
END = (
    ("footer",), ("footer", "p"), ("footer", "ul", "li"), ("div", ".footer"), ("div", ".footer", "p"), ("div", ".copyright"), ("section", ".comments", "p"), ("div", ".comments", "div", ".comment"),
    ("section", ".comments", "article", ".comment", "p"), ("div", ".comment", "p"), ("div", ".comment"), ("ul", ".comments", "li"), ("ol", ".comment", ".list", "li"), ("div", ".reader", ".comments", "p"),
    ("div", ".disqus"), ("section", ".comments", "h2"), ("div", ".responses", "p"), ("div", ".replies"), ("div", ".legal"), ("footer", "div"),
)

# Texts for layouts where a sample has none.
MAIN_TEXTS = (
    "The river rose through the night, and by the morning the lower fields stood under water up to the second rail of the fence.",
    "Nobody in the village could remember a spring like it, though the older people spoke of a flood in their grandparents' time.",
    "When the council met on Thursday, its members agreed to raise the bank before winter and to ask the county for half of the cost.",
)
OTHER_TEXTS = ("Home", "Contact", "About us", "All rights reserved", "Subscribe to our newsletter", "Share this page", "Related articles", "Log in")


def weak_label(block: Block) -> bool | None:
    """What a block's semantic elements say, where they say anything."""
    names = set(block.path)
    if names & OTHER_TAGS or any(w in names for w in (".ad", ".ads", ".comment", ".comments", ".sidebar", ".menu", ".footer")):
        return False
    return True if names & MAIN_TAGS else (False if "header" in names else None)


def layout(main: list[Block], other: list[str], r: random.Random) -> tuple[list[Block], np.ndarray]:
    """A page of the given main blocks and other texts, in places and under names drawn at random."""
    out: list[tuple[Block, bool]] = []
    root = ("html", "body") + r.choice(((), (), ("div",), ("div", ".wrapper"), ("div", ".page")))
    short = lambda: " ".join(r.choice(other).split()[: r.randint(1, 12)]) or "..."

    def put(places: tuple[tuple[str, ...], ...], most: int, under: tuple[str, ...] = ()) -> None:
        for _ in range(r.randint(0, most)):
            place = r.choice(places)
            if r.random() < 0.1:
                place = tuple(n for n in place if not n.startswith(".")) or ("div",)
            told = any(n.startswith(".") or n in TELLING for n in place)
            if place[-1] not in ("p", "li") and r.random() < 0.3:
                place = (*place, r.choice(("p", "p", "div", "h3")))
            for _ in range(r.choice((1, 1, 2, 5))):
                comment = any("comment" in n or n in (".replies", ".responses", ".disqus") for n in place)
                # whole sentences stand in any place whose names tell what it is, so that length alone decides nothing
                sentence = 0.6 if comment else 0.4 if told else 0.05
                text = " ".join(r.choice(main).text.split()[: r.randint(4, 60)]) if r.random() < sentence else short()
                linked = len(text) if ("li" in place and not comment and r.random() < 0.6) or r.random() < 0.15 else 0
                out.append((Block(root + under + place, text, linked), False))

    put(TOP, 3)
    wrap = r.choice(WRAPS) if r.random() < 0.7 else r.choice(WRAPS[:3])  # plain elements are the commonest
    if r.random() < 0.1:
        wrap = tuple(n for n in wrap if not n.startswith("."))
    put(SIDE, 2, wrap if r.random() < 0.2 else ())
    if r.random() < 0.4:
        out += [(Block(root + wrap + r.choice((("h1",), ("header", "h1"), ("h1", ".title"), ("h2",))), " ".join(r.choice(main).text.split()[:9]), 0), True)]
    for b in main:
        inner = b.path[-1:] if b.path[-1:] and b.path[-1] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else ("p",)
        if r.random() < 0.2:
            out.append((Block(root + wrap + r.choice((("h2",), ("h3",))), " ".join(r.choice(main).text.split()[: r.randint(1, 7)]), 0), True))
        if r.random() < 0.15:
            inner = r.choice((("blockquote",), ("blockquote", "p"), ("ul", "li"), ("figure", "figcaption"), ("pre",), ("div",)))
        out.append((Block(root + wrap + inner, b.text if r.random() < 0.7 else " ".join(b.text.split()[: r.randint(4, 14)]), b.linked), True))
        if r.random() < 0.3:
            put(r.choice((SIDE, SIDE, TOP, END)), 1, wrap if r.random() < 0.8 else ())
    put(SIDE, 2, wrap if r.random() < 0.3 else ())
    put(END, 3, wrap if r.random() < 0.4 else ())
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def train(sample: list[str], seed: int = 5) -> Labeller:
    """A labeller fitted on pages, as far as they have semantic elements, and on layouts made of their texts."""
    r, made = random.Random(seed), []
    pages = [blocks(h) for h in sample]
    other = [b.text for p in pages for b in p if weak_label(b) is False] or list(OTHER_TEXTS)
    texts = []
    for page in pages:
        main = [b for b in page if weak_label(b)]
        if main:
            known = [(b, weak_label(b)) for b in page]
            made.append((features(page)[:LONGEST], np.array([y is True for _, y in known], np.float32)[:LONGEST]))
        texts.append(main or [b for b in page if len(b.text) >= 80 and 2 * b.linked < len(b.text)])
    texts = [x for x in texts if x] or [[Block(("p",), t) for t in MAIN_TEXTS]]
    for main in texts:
        for _ in range(max(LAYOUTS, LAYOUTS * SAMPLE // len(texts))):  # as many in all from a smaller sample
            own, y = layout(main[: LONGEST // 2], other, r)
            made.append((features(own)[:LONGEST], y[:LONGEST]))
    drop = np.random.RandomState(seed)  # in many blocks words are left out, or are none that were ever seen, so that their tags must do
    for x, _ in made:
        chance = drop.random_sample(len(x))
        x[chance < 0.7, PATH_DIM : PATH_DIM + WORD_DIM] = 0
        strange = chance < 0.4
        x[strange, PATH_DIM : PATH_DIM + WORD_DIM] = drop.normal(size=(int(strange.sum()), WORD_DIM)) / np.sqrt(WORD_DIM) * 1.5
    return Labeller(seed).fit(made, seed=seed)


def sampled(rows: DataFrame) -> list[str]:
    """The html of SAMPLE pages at most: those with semantic elements first, by hash.  Only keys are ordered; html comes for those chosen."""
    html = F.lower("html")
    plain = ~(html.contains("<article") | html.contains("<main"))
    fit = rows.filter(F.length("html").between(1, LARGEST)).select("page_id", "url", plain.alias("plain"), F.xxhash64("html").alias("version"), "html")
    keys = fit.select("page_id", "url", "version").orderBy("plain", F.xxhash64("page_id", "url"), "version").limit(SAMPLE).distinct()
    keys = keys.select(F.col("page_id").alias("k_id"), F.col("url").alias("k_url"), F.col("version").alias("k_version"))
    same = (F.col("page_id") == F.col("k_id")) & F.col("url").eqNullSafe(F.col("k_url")) & (F.col("version") == F.col("k_version"))
    chosen = fit.join(F.broadcast(keys), same, "left_semi").select("page_id", "url", "version", "html").limit(SAMPLE).collect()  # SAMPLE keys
    return [r["html"] for r in sorted(chosen, key=lambda r: (r["page_id"], r["url"] or "", r["version"]))]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_main)`` for every row of ``pages(page_id, url, html)``.

    Main blocks in page order, white space within one turned into single spaces, joined by an empty line.  Null or
    empty html, and pages without main text, have an empty text.  Repeated rows give equal results; other columns are
    ignored.  Memory is bounded by the blocks of a page and about BLOCKS more, not by how many long pages stand together.
    """
    rows = pages.select(id_in(F.col("page_id")).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if labeller is None:
        labeller = train(sampled(rows))

    def done(rows: list[tuple], split: list[list[Block]]) -> pd.DataFrame:
        marks = labeller.label([features(p) for p in split])
        texts = ["\n\n".join(b.text for b, m in zip(p, own, strict=True) if m) for p, own in zip(split, marks, strict=True)]
        return pd.DataFrame(
            {"page_id": [p for p, _ in rows], "url": pd.Series([u for _, u in rows], dtype="object"), "text": texts, "n_chars": [len(t) for t in texts],
             "n_blocks": [len(p) for p in split], "n_main": [int(m.sum()) for m in marks]}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, split = [], []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                held.append((page_id, url))
                split.append(blocks(html if isinstance(html, str) else ""))
                if len(held) == 128 or sum(map(len, split)) >= BLOCKS:
                    yield done(held, split)
                    held, split = [], []
            if held:
                yield done(held, split)

    made = rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
    return made.withColumn("page_id", id_out(F.col("page_id")))
