"""Toxicity of restored text: a noisy channel undoes obfuscation, then learned words are scored.

1. A character model is counted over every whole text.
2. Words that may be tampered with (a character that looks like another letter, digits or signs
   among letters, a repeated letter, single letters standing apart) become lattices of what each
   character may stand for; Viterbi decoding picks the likeliest text, in which a sign at either
   end may also be plain punctuation, and a sign inside may end a word, so that words joined by
   signs are restored one by one. Words are kept as written too; numbers stay numbers.
3. From labelled rows outside the held-out fold, words and word stems (first letters) that
   mark toxic texts are found by their log-likelihood ratio and weighed by an L1 logistic
   regression; a mark that it keeps and that is sure by itself weighs at least its own log odds.
4. A text's score is the regression over the marks it holds, as written or restored.

Defined cases: a null or empty text scores the prior; rows without a doc_id are scored and
not held out; repeated rows each come out; without labels every score is the prior; an
empty table gives no rows; other columns are never read for a score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprop.llm import char_model
from lexiprop.llm.common import column, free_name, release_memory, stored, texts_of
from lexiprop.llm.lasso import fit_lasso

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled rows the classifier is fitted on (smallest seeded hashes first); bounds driver and broadcast.
TRAIN_ROWS = 20_000
#: Marks kept, and the toxic training texts a mark must appear in.
MAX_MARKS, MIN_TEXTS = 400, 4
#: Half the log-likelihood ratio a mark must reach, so that chance finds among very many words are rare.
LEAST_RATIO = 10.0
#: From this half ratio on a mark is sure enough (about one in 10^8 by chance) to count by itself.
SURE_RATIO = 16.0
#: ... if it has at most this many clean training texts for each toxic one.
MOST_CLEAN = 0.01
PENALTY = 1e-4
#: Lengths of the stems of longer words; a stem ends in STEM.
STEMS, STEM = (4, 5, 6), "~"
#: Chunks with more runs of equal characters are restored in overlapping windows of so many, which begin
#: where a word may; of a single longer word the first so many give its stems (no vocabulary word is that long).
LONGEST_WORD = 40

_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(c for c in char_model.LOOKS_LIKE if not c.isalnum()))
_HEAD, _TAIL = re.compile(rf"^[^\w{_SIGNS}]+"), re.compile(rf"[^\w{_SIGNS}]+\Z")
_ENDING = re.compile(r"[^\w]+\Z")
_SUSPECT = re.compile(r"([^\W\d_])\1|[%s]" % re.escape("".join(char_model.LOOKS_LIKE)))
_PARTS = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1*+", re.S)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """True for rows whose label must not be learned: crc32 of the doc_id's digits, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tampered(core: str) -> bool:
    """Whether a word without its outer punctuation may be obfuscated."""
    if len(core) < 3:
        return False
    if core.isalpha():
        return bool(_SUSPECT.search(core))
    # digits without a letter (or an @) are a number
    return any(c.isalpha() or c == "@" for c in core) or not any(c.isdigit() for c in core)


def bare(low: str) -> str:
    """A chunk without the signs around it; signs before it that may stand for letters stay."""
    return _ENDING.sub("", _HEAD.sub("", low))


def marks_of(words: list[str]) -> list[str]:
    """The words and the stems of those that are longer."""
    return words + [w[:n] + STEM for w in words for n in STEMS if len(w) > n]


def windows(core: str) -> Iterator[str]:
    """The chunk, or overlapping windows of LONGEST_WORD runs that begin at its start or behind a sign."""
    runs = list(_RUN.finditer(core))
    if len(runs) <= LONGEST_WORD:
        yield core
        return
    signs = [i for i, r in enumerate(runs) if not r[1].isalnum()]
    at = 0
    while at < len(runs):
        end = min(at + LONGEST_WORD, len(runs))
        yield core[runs[at].start() : runs[end - 1].end()]
        # the next window starts behind the last sign of the first half, else behind the next sign
        half = bisect_right(signs, at + LONGEST_WORD // 2 - 1)
        later = bisect_right(signs, at)
        if end == len(runs) or later == len(signs):
            return
        at = signs[half - 1 if half > later else later] + 1


class Reader:
    """Words and stems of a text, written and restored. Distinct chunks are decoded once; the memory of
    them is emptied when ``room`` is used up."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None, room: int = 1 << 18):
        self.model, self.wanted, self.room, self.known = model, wanted, room, {}
        self.heads = {m[: STEMS[0]] for m in wanted or () if m.endswith(STEM)}
        self.beginnings = {m.rstrip(STEM)[:n] for m in wanted or () for n in range(STEMS[0] + 1)}
        # short words are whole where a space follows
        self.beginnings |= {m + " " for m in wanted or () if len(m) < STEMS[0] and not m.endswith(STEM)}

    def words_of(self, chunk: str) -> tuple:
        """Of a chunk between spaces: its marks, or the numbers of the wanted ones; True first if it is one character."""
        low = chunk.lower()
        if low.isalpha() or low[:-1].isalpha() and not low[-1].isalnum():  # most chunks: a word, maybe with a mark behind it
            plain = low if low[-1].isalpha() else low[:-1]
            core = low if low[-1] in char_model.LOOKS_LIKE else plain
            found = [plain]
        else:
            plain, core = bare(low), _TAIL.sub("", _HEAD.sub("", low))
            found = _WORDS.findall(low)
        if tampered(core):
            found += self.restored(core)
        single = len(plain) == 1 or len(low) == 1 and low in char_model.LOOKS_LIKE
        return (single, *self.marks(found))

    def restored(self, core: str) -> list[str]:
        """The words of an obfuscated chunk: as one word, with signs inside that may also end a word, and each
        part between signs by itself."""
        found = []
        signs = bool(_PARTS.search(core))
        # one look that allows all of this; most chunks end here
        if self.wanted is not None and not char_model.may_begin(core, self.beginnings, STEMS[0], edges=True, breaks=signs):
            return found
        parts = [p for p in _PARTS.split(core) if tampered(p)]
        for whole in dict.fromkeys([core, *parts]):
            for part in windows(whole):
                for breaks in (False, True) if _PARTS.search(part) else (False,):
                    # words that can't become a wanted one need no decoding
                    if self.wanted is None or char_model.may_begin(part, self.beginnings, STEMS[0], edges=True, breaks=breaks):
                        words = char_model.decode(part, self.model, edges=True, breaks=breaks).split()
                        # the last word of a window may go on in the next one
                        found += words if len(words) < 2 or whole.endswith(part) else words[:-1]
        return found

    def marks(self, words: list[str]) -> list:
        if self.wanted is None:
            return marks_of(words)
        # stems are looked up only where the first letters are those of a wanted one
        found = [w for w in words if w in self.wanted]
        found += [m for m in marks_of([w for w in words if w[: STEMS[0]] in self.heads]) if m.endswith(STEM) and m in self.wanted]
        return [self.wanted[m] for m in found]

    def words(self, text: str | None) -> set:
        out: set = set()
        if not text:
            return out
        chunks = text.split()
        known = self.known
        if len(known) > self.room:
            known.clear()
        for c in set(chunks):
            if c not in known:
                known[c] = self.words_of(c)
        apart = False
        for c in chunks:
            w = known[c]
            if len(w) > 1:
                out.update(w[1:])
            apart = apart or w[0]
        if apart:
            for run in self.spaced(chunks):
                # a true one-letter word may stand before or behind the one that was drawn apart
                for part in (run, run[1:], run[:-1]):
                    out.update(self.marks(char_model.decode(part, self.model, spaced=True).split()))
        return out

    def spaced(self, chunks: list[str]) -> Iterator[str]:
        """Runs of three or more characters that stand apart, put together (at most ``LONGEST_WORD`` at a time, overlapping by half)."""
        run: list[str] = []
        for c in [*chunks, ""]:
            if c and self.known[c][0]:
                low = c.lower()
                run.append(bare(low) or low[0])
                continue
            if len(run) > 2:
                for i in range(0, max(1, len(run) - LONGEST_WORD // 2), LONGEST_WORD // 2):
                    yield "".join(run[i : i + LONGEST_WORD])
            run = []


class ToxicityModel:
    """Character table, marks and their weights."""

    def __init__(self, table: np.ndarray, marks: list[str], weights: np.ndarray, bias: float):
        self.table, self.marks, self.weights, self.bias = table, marks, weights, bias

    def scorer(self):
        reader = Reader(self.table, {m: i for i, m in enumerate(self.marks)})

        def score(text: str | None) -> float:
            at = list(reader.words(text))
            return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum()))))

        return score

    def with_scores(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """All rows and columns of ``docs`` with a score of their text (any former column of that name goes)."""
        docs = docs.drop(name)
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
        text_at = docs.columns.index("text") if "text" in docs.columns else None

        def run(batches):
            score = self.scorer()
            for b in batches:
                texts = texts_of(b, text_at) if text_at is not None else [None] * b.num_rows
                scores = pa.array([score(None if t is None else str(t)) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])
            del score
            release_memory()

        return docs.mapInArrow(run, schema)


def train_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, most: int) -> DataFrame:
    """``(doc_id, label)``: at most ``most`` labelled rows outside the held-out fold, by seeded hash."""
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, target, "int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    return known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN_ROWS, max_marks: int = MAX_MARKS, penalty: float = PENALTY) -> ToxicityModel:
    """The model of ``docs`` (texts) and ``labels`` (``toxic`` of each doc_id)."""
    spark = docs.sparkSession
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    counts = char_model.corpus_counts(texts)
    table = char_model.log_model(counts)
    chosen = stored(train_rows(texts, labels, "toxic", FOLDS, HELD_OUT, train), "train-rows")
    # at most ``train`` rows are broadcast, and as many texts kept
    own = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"), "train-texts")

    def count(batches):
        reader = Reader(table)
        for b in batches:
            n: list[Counter] = [Counter(), Counter()]
            for text, label in zip(texts_of(b, 0), b.column(1).to_pylist()):
                n[label].update(reader.words(text))
            marks = sorted(n[0].keys() | n[1].keys())
            sums = [pa.array([n[k][m] for m in marks], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), *sums], ["mark", "k1", "k0"])

    sums = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    n1, n0 = sums.get(1, 0), sums.get(0, 0)
    if not n1 or not n0:
        prior = (n1 + 0.5) / (n0 + n1 + 1)
        return ToxicityModel(table, [], np.zeros(0), float(np.log(prior / (1 - prior))))
    per_mark = own.mapInArrow(count, "mark string, k1 long, k0 long").groupBy("mark").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    rate = (F.col("k1") + F.col("k0")) / F.lit(n0 + n1)
    ratio = F.col("k1") * F.ln((F.col("k1") + 0.5) / (n1 * rate)) + F.col("k0") * F.ln((F.col("k0") + 0.5) / (n0 * rate))
    marked = per_mark.filter((ratio >= LEAST_RATIO) & (F.col("k1") >= MIN_TEXTS) & (F.col("k1") / n1 > 3 * F.col("k0") / n0))
    chosen = marked.select("*", ratio.alias("ratio")).orderBy(F.desc("ratio"), "mark").limit(max_marks).collect()
    marks = [r.mark for r in chosen]
    at = {m: i for i, m in enumerate(marks)}

    def find(batches):
        reader = Reader(table, at)
        for b in batches:
            found = [sorted(reader.words(t)) for t in texts_of(b, 0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "marks"])

    # texts with the same marks make one line; there are at most as many lines as training rows
    lines = own.mapInArrow(find, "label int, marks array<int>").groupBy("label", "marks").count().collect()
    lines.sort(key=lambda r: (r.label, r.marks))
    x = np.zeros((len(lines), len(marks)))
    for i, r in enumerate(lines):
        x[i, r.marks] = 1
    weights, bias = fit_lasso(x, np.array([float(r.label) for r in lines]), penalty, np.array([r["count"] for r in lines]))
    # texts often hold several marks, among which the regression shares the weight: a sure one
    # that it keeps weighs at least what its own counts give it
    alone = np.array([np.log((r.k1 + 0.5) / (r.k0 + 0.5)) - bias if r.ratio >= SURE_RATIO and r.k0 <= MOST_CLEAN * r.k1 else 0.0 for r in chosen])
    weights = np.where(weights > 0, np.maximum(weights, alone), weights)
    used = np.flatnonzero(weights)
    marks = [marks[i] for i in used]
    written = [m.rstrip(STEM) for m in marks]
    return ToxicityModel(char_model.log_model(counts, written), marks, weights[used], bias)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    scored = model.with_scores(rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    score = free_name(docs, "score")
    return model.with_scores(docs, score).filter(F.col(score) < THRESHOLD).drop(score)
