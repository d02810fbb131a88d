"""Personal data: patterns find the protected entities, corpus statistics find the terms that give them away.

Addresses, cards and phone numbers that the patterns find are the protected entities.  What a term t discloses of an entity e is
``PMI(t; e) / IC(e) = log2(P(e | t) / P(e)) / log2(1 / P(e))``, 1 if t occurs nowhere but with e; what it leaves open is
``-log2 P(e | t)`` bits.  P(e) is e's share of all documents.  P(e | t) is not the plain ratio of counts but the lower end of its
Wilson interval, so that few observations prove little:

* documents that hold t are observations of whether e is in them; copies (the same words around each mention of e) count once;
* standing within REACH words of e is one more observation for each such passage.

So a rare word right beside an entity, or one that comes back with it in different passages, discloses it, and a rare word elsewhere
in the one document that names it doesn't.  Terms over both thresholds are spans of kind ``term`` wherever they stand, also in
documents without e, and the text replaces them as it does the entities.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import BITS, bitmap, id_in, id_out, staged
from evidentia.llm.spans import Span, identified, masked, sha256, written

# The kinds of base spans in their order, and the characters of their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"(?<![0-9])[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
ENDS = ".,;:!?\"'()[]{}<>*#$%&|"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

REACH = 5  # words on either side of an entity that are its surroundings
DISCLOSES = 0.8  # least share of the entity's information that a telling term discloses
LEAVES = 1.0  # most bits that it leaves open
Z = 1.28  # of the Wilson interval: nine in ten true ratios are above its lower end
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, found from each @: the local part reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = max(done, text.rfind("@", 0, at) + 1)
        start = at
        while start > before and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted quadruples.  A match can only begin where a run of digits does, as it takes whole runs but for the last."""
    at = 0
    while m := DIGITS.search(text, at):
        if found := IP.match(text, m.start()):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found[0].split(".")):
                yield found.span()
            at = found.end()
        else:
            at = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, by kind and start: leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if not ANY_DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in _ips(text)]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, found: str) -> str:
    """One name for all spellings of an entity."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', found)}"


def term(word: str) -> str:
    """A word without punctuation at its ends, lowered; empty if that leaves less than three characters."""
    word = word.strip(ENDS).lower()
    return word if len(word) >= 3 else ""


def pieces(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """Words outside the spans; of a word that a span cuts, what stands outside."""
    at = 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if at < a:
            yield from WORD.finditer(text, at, a)
        at = max(at, b)
    yield from WORD.finditer(text, at)


def mentions(text: str, spans: list[Span]) -> list[tuple[str, str, list[str]]]:
    """(entity, digest of the words within REACH of it, their terms) for every entity."""
    out, taken = {}, bytearray(len(text))
    for _, a, b in spans:
        taken[a:b] = b"\1" * (b - a)
    ends = [m.span() for m in WORD.finditer(text)] if spans else []
    starts = [a for a, _ in ends]
    for kind, a, b in spans:
        i = bisect_left(starts, a)
        before = [(x, min(y, a)) for x, y in ends[max(0, i - REACH) : i]]
        near = [text[x:y] for x, y in before + [m.span() for m in islice(WORD.finditer(text, b), REACH)] if 1 not in taken[x:y]]
        out[entity(kind, text[a:b]), sha256(" ".join(near))[:16]] = sorted({term(w) for w in near} - {""})
    return [(e, around, near) for (e, around), near in sorted(out.items())]


SCANNED = (
    "doc_id long, version long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "entities array<struct<entity:string,around:string,near:array<string>>>, terms array<string>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, version in zip(batch["doc_id"].array, batch["text"], batch["version"], strict=True):
            text = text if isinstance(text, str) else ""
            spans = base_spans(text)
            base, n = written(spans), Counter(k for k, _, _ in spans)
            own = [dict(zip(("entity", "around", "near"), m, strict=True)) for m in mentions(text, spans)]
            terms = sorted({term(m[0]) for m in pieces(text, spans)} - {""}) if spans else []
            out.append((doc_id, version, *(n[k] for k in KINDS), sha256(base), base, own, terms))
        yield pd.DataFrame(out, columns=["doc_id", "version", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "entities", "terms"])


def _terms(text: str) -> tuple[list[Span], set[str]]:
    """The base spans of a text, and the terms outside them."""
    spans = base_spans(text)
    return spans, set(map(term, {m[0] for m in pieces(text, spans)} if spans else set(WORD.findall(text)))) - {""}


def _has(bits: bytes, found: str) -> bool:
    at = zlib.crc32(found.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n_seen)``: how many documents hold each wanted term."""
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, F.crc32("term")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, seen = marked.value, Counter()
        flush = lambda: pd.DataFrame({"term": list(seen), "n": list(seen.values())}).astype({"term": "object", "n": "int64"})
        for batch in batches:
            for text in batch["text"]:
                if isinstance(text, str):
                    seen.update(t for t in _terms(text)[1] if _has(bits, t))
                    if len(seen) > 100_000:
                        yield flush()
                        seen.clear()
        yield flush()

    counted = texts.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_seen"))
    return counted.join(wanted, "term", "left_semi")


def _places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, version, start, end)``: where every document holds the wanted terms."""
    marked, columns = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, F.crc32("term"))), ["doc_id", "version", "term", "start", "end"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = marked.value
        for batch in batches:
            out = []
            for doc_id, text, version in zip(batch["doc_id"].array, batch["text"], batch["version"], strict=True):
                if not isinstance(text, str):
                    continue
                spans, held = _terms(text)
                held = {t for t in held if _has(bits, t)}
                for m in pieces(text, spans) if held else ():
                    if (t := term(m[0])) in held:
                        out.append((doc_id, version, t, m.end() - len(m[0].lstrip(ENDS)), m.start() + len(m[0].rstrip(ENDS))))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    held = texts.mapInPandas(find, "doc_id long, version long, term string, start long, end long")
    return held.join(wanted, "term", "left_semi").drop("term")


def disclosed(n_docs: int, n_entity: Column, n_seen: Column, n_both: Column, n_around: Column, n_near: Column) -> tuple[Column, Column]:
    """The share of the entity's information that a term discloses, and the bits that it leaves open."""
    n = n_seen * n_around / n_both + n_near
    p = (n_around + n_near) / n
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return F.log2(low * n_docs / n_entity) / F.log2(F.lit(n_docs) / n_entity), -F.log2(low)


def _over(pairs: DataFrame, n_docs: int, n_seen: str, n_around: str) -> DataFrame:
    """The pairs over both thresholds."""
    share, open_ = disclosed(n_docs, *[F.col(c) for c in ("n_entity", n_seen, "n_both", n_around, "n_near")])
    return pairs.withColumns({"share": share, "open": open_}).filter((F.col("share") >= DISCLOSES) & (F.col("open") <= LEAVES))


def _digest(*cols: str) -> list[Column]:
    """128 bits of a set of rows, whatever their order and number: nothing is collected."""
    return [F.bit_xor(F.xxhash64(F.lit(i), *cols)).alias(f"d{i}") for i in (1, 2)]


def telling_terms(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which terms tell of which entities: ``(near, far, members)``.

    ``near(entity, term, ..)`` are pairs that stand beside each other somewhere.  ``far(entity, term, ..)`` are pairs that only documents bring
    together; its entity stands for all of ``members(entity, member)``, which are in the same documents with passages that repeat in the
    same way.  Both have ``n_entity n_seen n_both n_around n_near share open``.  A list of n addresses and m names that comes back in several
    documents is a class or two of each side there, not n times m pairs.
    """
    n_docs, doc = found.count(), ["doc_id", "version"]
    holds = found.filter("size(entities) > 0").dropDuplicates(doc)  # rows equal in doc_id and text are one document
    holds = staged(holds.select(*doc, F.xxhash64(F.lit(0), *doc).alias("at"), "entities", "terms"), "holds")
    who = holds.select("at", F.inline("entities"))
    near = who.select("entity", "around", F.explode("near").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_near"))
    each = staged(who.groupBy("at", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("around"))).alias("passages")), "each")
    known = each.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("passages").alias("n_all")).filter(F.col("n_entity") < n_docs)
    known = staged(known, "known")
    held = staged(holds.select("at", F.explode("terms").alias("term")), "held")

    # entities of several passages count in whole documents: classes of them, each by the documents and which of these repeat a passage
    several = each.join(known.filter("n_all > 1").select("entity", "n_entity"), "entity")
    labels = several.groupBy("entity", "passages").agg(F.min("at").alias("label"))
    several = staged(several.join(labels, ["entity", "passages"]).select("entity", "n_entity", "at", "label"), "several")
    classes = several.groupBy("entity", "n_entity").agg(*_digest("at", "label"))
    lead = classes.groupBy("n_entity", "d1", "d2").agg(F.min("entity").alias("lead"))
    members = staged(classes.join(lead, ["n_entity", "d1", "d2"]).select(F.col("lead").alias("entity"), F.col("entity").alias("member"), "n_entity"), "members")
    # and of terms, by their documents
    kinds = held.groupBy("term").agg(F.count("*").alias("n_least"), *_digest("at"))
    first = kinds.groupBy("n_least", "d1", "d2").agg(F.min("term").alias("first"))
    kinds = staged(kinds.join(first, ["n_least", "d1", "d2"]).select("term", "first", "n_least"), "kinds")

    pairs = near.join(known, "entity").join(kinds, "term").join(members.select(F.col("entity").alias("lead"), F.col("member").alias("entity")), "entity", "left")
    pairs = staged(pairs, "near")
    asked = pairs.filter("lead is not null").select(F.col("lead").alias("entity"), F.col("first").alias("term"), F.lit(1).alias("asked")).distinct()
    leads = several.join(members.select("entity").distinct(), "entity", "left_semi")
    firsts = held.join(kinds.filter("term = first").select("term", "n_least"), "term")
    # beside none of its mentions, a term discloses an entity only if most of the term's documents hold that, two at least
    met = leads.join(firsts, "at").join(asked, ["entity", "term"], "left").filter("asked is not null or (n_least > 1 and 2 * n_entity > n_least)")
    met = met.groupBy("entity", "term", "n_entity", "n_least").agg(F.max("asked").alias("asked"), F.count("*").alias("n_both"), F.count_distinct("label").alias("n_around"))
    met = staged(met.filter("asked is not null or 2 * n_both > n_least"), "met")

    # bound: at least as many documents hold a term as do so with any entity
    far = _over(met.withColumn("n_near", F.lit(0).cast("long")), n_docs, "n_least", "n_around").select("entity", F.col("term").alias("first"), "n_entity", "n_both", "n_around", "n_near")
    far = staged(far.join(kinds.select("first", "term"), "first").drop("first"), "far")
    counts = met.select(F.col("entity").alias("lead"), F.col("term").alias("first"), "n_both", "n_around")
    alone = F.col("lead").isNull()  # one passage only: it stands in all of the entity's documents
    pairs = pairs.join(counts, ["lead", "first"], "left").withColumns({"n_both": F.when(alone, F.col("n_entity")).otherwise(F.col("n_both")), "n_around": F.when(alone, 1).otherwise(F.col("n_around"))})
    pairs = staged(_over(pairs, n_docs, "n_least", "n_around").select("entity", "term", "n_entity", "n_both", "n_around", "n_near"), "bounded")
    seen = staged(_occurrences(texts, staged(pairs.select("term").union(far.select("term")).distinct(), "wanted")), "seen")
    return tuple(staged(_over(x.join(seen, "term"), n_docs, "n_seen", "n_around"), "telling") for x in (pairs, far)) + (members.select("entity", "member"),)


def telling_pairs(near: DataFrame, far: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ``telling_terms``, one row for each entity and term: as many as there are, which may be entities times terms."""
    every = far.join(members, "entity").drop("entity").withColumnRenamed("member", "entity")
    return near.unionByName(every.join(near.select("entity", "term"), ["entity", "term"], "left_anti"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no spans.  Rows equal in doc_id and text share one result.  Other columns are ignored.
    Texts of any length are read whole, three times; what is shuffled are the terms beside entities, the terms of documents that hold an
    entity, classes of both that meet in a document, counts of terms that may disclose one, and where those that do stand.
    """
    texts, doc = identified(docs), ["doc_id", "version"]
    found = staged(texts.mapInPandas(_scan, SCANNED), "found")
    near, far, _ = telling_terms(texts, found)
    telling = staged(near.select("term").union(far.select("term")).distinct(), "terms")
    more = _places(texts, telling).groupBy(*doc).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    more = staged(more.withColumnsRenamed({"doc_id": "t_id", "version": "t_version"}), "more")
    added = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    out = found.drop("entities", "terms").join(more, (F.col("doc_id") == F.col("t_id")) & F.col("version").eqNullSafe(F.col("t_version")), "left")
    columns = [id_out(F.col("doc_id")).alias("doc_id"), "version", *(f"n_{k}" for k in KINDS), "base_sha256"]
    return out.select(*columns, F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), added).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with entities and telling terms generalised to their kind."""
    found = scan(docs).select(id_in(F.col("doc_id")).alias("s_id"), F.col("version").alias("s_version"), "spans").distinct()
    texts = identified(docs)
    both = texts.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("version") == F.col("s_version")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                marks = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
                out.append(masked(text, marks, MARKS) if isinstance(text, str) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": pd.Series(out, dtype="object")})

    return both.select("doc_id", "text", "spans").mapInPandas(run, "doc_id long, text string").withColumn("doc_id", id_out(F.col("doc_id")))
