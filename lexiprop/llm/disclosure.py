"""Personal data, and the terms that give it away.

1. Addresses, numbers and cards are found by fixed patterns in every whole text.
2. A found value is a protected entity, and so is the group it belongs to: an address's domain,
   the first two parts of an IP, a card's issuer digits, a phone number without its last four.
   Over all documents, co-occurrence estimates how much a term tells of an entity:
   ``PMI(entity; term) = log(N * P(entity | term) / n(entity))`` against the entity's own
   information ``IC = log(N / n(entity))``. The share PMI / IC is 1 where every document with the
   term holds the entity. ``P(entity | term)`` enters with its lower confidence bound (Wilson's,
   ``confidence`` standard deviations) over the different texts that bear it out, so rare terms
   need better evidence than frequent ones.
3. In every document, terms of a share of at least ``generalise_from`` become their shape, and
   from ``remove_from`` on they go, whether the document holds the entity or not: the term alone
   would tell of it. Copies of one text are no evidence, and a term or entity found in fewer than
   ``min_contexts`` different texts has none. Texts that differ only in case and white space count
   as copies.

Defined cases: a null text counts as empty; empty texts have no spans; repeated rows each
come out (and count as documents, but as one text); rows without a doc_id are searched
like others; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import column, join_groups, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
MIN_CONTEXTS, GENERALISE_FROM, REMOVE_FROM = 2, 0.9, 0.97
#: Standard deviations between an estimate and its lower bound.
CONFIDENCE = 1.0
#: The least letters of a term.
TERM_LETTERS = 3
#: Bits for each of a word's two marks in the filter that keeps words which are no candidate out of the
#: shuffle (a fixed size, 4 MB in all).
FILTER_BITS = 1 << 24
_WORDS_AT_ONCE = 1 << 16

# The possessive forms match what the plain ones do, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{%d,}" % TERM_LETTERS)
_DIGIT = re.compile("[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    found = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def entities_of(kind: str, value: str) -> tuple[str, str]:
    """Names of a value, the same for its different spellings, and of the group it belongs to."""
    if kind in ("email", "ip"):
        whole = value.lower()
        group = whole.rpartition("@")[2] if kind == "email" else ".".join(whole.split(".")[:2])
    else:
        whole = _DIGIT.sub("", value)
        group = whole[:6] if kind == "card" else whole[:-4]
    return f"{kind}:{whole}", f"{kind} group:{group}"


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Where terms stand, outside ``spans``."""
    covered = sorted((s, e) for _, s, e in spans)
    out, i, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(covered) and covered[i][0] < m.end():
            reach = max(reach, covered[i][1])
            i += 1
        if m.start() >= reach:
            out.append(m.span())
    return out


def _context(text: str, names: list[str]) -> int:
    """Digest of the whole text and its entities, the same for copies that differ in case and white space."""
    same = "\0".join([" ".join(text.lower().split()), *names])
    return int.from_bytes(hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_entities(docs: DataFrame) -> DataFrame:
    """``(context, text, spans, names)`` of every row in which something was found: the digest of its
    text, the text, the spans and the entities' names."""

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in texts_of(b, 0):
                found = base_spans(text or "")
                if not found:
                    continue
                names = sorted({n for kind, s, e in found for n in entities_of(kind, text[s:e])})
                for o, v in zip(out, (_context(text, names), text, joined(found), names)):
                    o.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["context", "text", "spans", "names"])

    rows = docs.select(column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "context long, text string, spans string, names array<string>")


def _parse(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


class _Listed:
    """The terms of a chunk between spaces that a filter of fixed size lets through."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.known: dict[str, tuple[str, ...]] = {}

    def _may(self, term: str) -> bool:
        code = zlib.crc32(term.encode("utf-8", "surrogatepass"))
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in (code % FILTER_BITS, FILTER_BITS + (code >> 8)))

    def terms(self, text: str | None) -> set[str]:
        chunks = set((text or "").split())
        if len(self.known) > 1 << 19:
            self.known.clear()
        for c in chunks:
            if c not in self.known:
                self.known[c] = tuple(t for t in _TERM.findall(c.lower()) if self._may(t))
        return {t for c in chunks for t in self.known[c]}


def _filter_of(terms: DataFrame) -> np.ndarray:
    """Bits of which two are set for every ``term``; Spark gathers them in pieces of 4 KB."""
    code = F.crc32(F.col("term").cast("binary"))
    # positions count from 1
    marks = F.array(F.pmod(code, F.lit(FILTER_BITS)) + 1, F.shiftright(code, 8) + (FILTER_BITS + 1))
    at = terms.select(F.explode(marks).alias("at"))
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(2 * FILTER_BITS // 8, np.uint8)
    for piece, bits in pieces.collect():  # at most 1,024
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, np.uint8)
    return out


def document_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(term, n)``: in how many rows of ``docs`` each of the ``candidates`` (``term``) stands.

    A filter made of all candidates keeps most other words out; tasks count what passes before
    it is shuffled.
    """
    bits = _filter_of(candidates)

    def run(batches):
        listed = _Listed(bits)
        for b in batches:
            counts: Counter = Counter()
            for text in texts_of(b, 0):
                counts.update(listed.terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counted = docs.select(column(docs, "text", "string").alias("text")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).join(candidates, "term", "left_semi")


def share_told(n_both: Column, contexts: Column, n_term: Column, n_entity: Column, n_all: int, confidence: float) -> Column:
    """What a term tells of an entity, as a share of the entity's information.

    ``n_both`` of the term's ``n_term`` rows hold the entity, in ``contexts`` different texts.
    """
    p = F.least(F.lit(1.0), n_both / n_term)
    n, z2 = contexts / p, float(confidence**2)
    spread = F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    low = (p + F.lit(z2) / (2 * n) - F.lit(float(confidence)) * spread) / (1 + F.lit(z2) / n)
    content = F.ln(F.lit(float(n_all)) / n_entity)
    return F.when(content > 0, 1 + F.ln(F.greatest(low, F.lit(1e-300))) / content).otherwise(F.lit(0.0))


def disclosing_terms(
    docs: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    generalise_from: float = GENERALISE_FROM,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``(name, term, n_term, share)``: the terms that tell at least the share ``generalise_from`` of an entity.

    Copies of a text become one row with their number before its words are listed. Words and entities
    are counted each for itself first; only those that can reach the share are joined by their text.
    """
    found = stored(find_entities(docs), "found")
    n_all = docs.count()
    texts = found.groupBy("context").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("text", "spans", "names")).alias("t"))
    texts = stored(texts.select("context", "k", "t.*"), "texts")
    n_texts = texts.count()

    def words(batches):
        for b in batches:
            at: list[int] = []
            terms: list[str] = []
            for i, text in enumerate(texts_of(b, 2)):
                own = {text[s:e].lower() for s, e in terms_of(text, _parse(b.column(3)[i].as_py()))}
                at.extend([i] * len(own))
                terms.extend(own)
                if len(terms) > _WORDS_AT_ONCE or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(terms, pa.string())], ["context", "k", "term"])
                    at, terms = [], []

    def counted(rows: DataFrame, key: str, rows_name: str) -> DataFrame:
        sizes = rows.groupBy(key).agg(F.sum("k").alias(rows_name), F.count(F.lit(1)).alias("size"))
        return stored(sizes.filter(F.col("size") >= min_contexts), key)

    held = texts.select("context", "k", F.explode("names").alias("name"))
    beside = stored(texts.select("context", "k", "text", "spans").mapInArrow(words, "context long, k long, term string"), "words")
    entities, terms = counted(held, "name", "n_entity"), counted(beside, "term", "n_found")
    watched = join_groups(held, entities, "name", "size", n_texts).select("context", "name", "n_entity")
    known = join_groups(beside, terms, "term", "size", n_texts).select("context", "k", "term", "n_found")
    pairs = known.join(watched, "context").groupBy("name", "term", "n_entity", "n_found")
    pairs = pairs.agg(F.sum("k").alias("n_both"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= min_contexts)

    def share(n_term: str) -> Column:
        return share_told(F.col("n_both"), F.col("contexts"), F.col(n_term), F.col("n_entity"), n_all, confidence)

    # no term stands in fewer rows of the corpus than in those with entities, so what fails here fails below
    pairs = stored(pairs.filter(share("n_found") >= generalise_from - 1e-9), "pairs")
    counts = document_counts(docs, pairs.select("term").distinct())
    told = pairs.join(counts.withColumnRenamed("n", "n_term"), "term")
    return told.select("name", "term", "n_term", share("n_term").alias("share")).filter(F.col("share") >= generalise_from)


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with found values named by their kind, generalised terms as shapes, removed terms gone."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        shape = "".join("X" if c.isupper() else "x" for c in text[s:e])
        out += [text[at:s], "" if kind == "removed" else shape if kind == "generalised" else f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _read_rows(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(doc_id, text, spans, hits)`` of every row: its spans, the words that may be ``flagged`` terms,
    and the text where it has either."""
    bits = _filter_of(flagged)

    def run(batches):
        listed = _Listed(bits)
        for b in batches:
            texts, spans, hits = [], [], []
            for text in texts_of(b, 1):
                found = base_spans(text or "")
                held = sorted(listed.terms(text))
                texts.append(text if found or held else None)
                spans.append(joined(found))
                hits.append(held)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.string()), pa.array(hits, pa.list_(pa.string()))],
                ["doc_id", "text", "spans", "hits"],
            )

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, spans string, hits array<string>")


def find_private(
    docs: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    generalise_from: float = GENERALISE_FROM,
    remove_from: float = REMOVE_FROM,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, sanitised)`` for every row.

    ``spans`` lists ``kind:start:end`` of the base kinds, then of ``removed`` and ``generalised``
    terms; ``sanitised`` is null where there are no spans.
    """
    told = disclosing_terms(docs, min_contexts, generalise_from, confidence)
    told = told.groupBy("term").agg((F.max("share") >= remove_from).alias("removed"), F.max("n_term").alias("n_term"))
    flagged = stored(told, "flagged")
    read = stored(_read_rows(docs, flagged).withColumn("row", F.monotonically_increasing_id()), "read")
    hits = read.select("row", F.explode("hits").alias("term"))
    hits = join_groups(hits, flagged, "term", "n_term", docs.count()).groupBy("row").agg(F.collect_list(F.struct("term", "removed")).alias("terms"))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, text in enumerate(texts_of(b, 1)):
                spans, terms = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                base = _parse(spans)
                n = Counter(k for k, _, _ in base)
                removed = {t["term"]: t["removed"] for t in terms or ()}
                extra = [(TERM_KINDS[not removed[w]], s, e) for s, e in terms_of(text, base) if (w := text[s:e].lower()) in removed] if removed else []
                extra.sort(key=lambda x: (TERM_KINDS.index(x[0]), x[1]))
                every = base + extra
                values = [*(n[k] for k in KINDS), hashlib.sha256(spans.encode()).hexdigest(), joined(every), len(extra), sanitise(text, every) if every else None]
                for o, v in zip(out, values):
                    o.append(v)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms", "sanitised"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc_id", *names])

    rows = read.join(hits, "row", "left").select("doc_id", "text", "spans", "terms")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, sanitised string")
