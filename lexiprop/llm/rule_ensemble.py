"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every text are taken where the documents are read.
2. Boosted shallow trees are grown on the labelled rows outside the held-out fold; each path
   from a root to a node is a rule, a conjunction of bounds on statistics.
3. An L1 logistic regression over the rules keeps the few that matter.
4. The kept rules are compiled into one Spark column expression, which scores every row.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; rows
without a doc_id are scored and not held out; repeated rows each come out; without labels, or
with one class only, every score is the prior; an empty table gives no rows; other columns
are never read for a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import column, stored, texts_of
from lexiprop.llm.toxicity_channel import held_out

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
TREES, DEPTH, SEED = 12, 3, 11
PENALTY = 2e-3
_BYTES_AT_ONCE = 1 << 22

STATISTICS = (
    "words", "word_length", "distinct_words", "short_words", "plain_words",
    "upper", "digits", "marks", "signs", "bars", "spaces", "lines", "line_length", "repeated_lines",
)
_KINDS = "upper lower digits marks signs bars spaces breaks other".split()


def _kind_of_byte() -> np.ndarray:
    table = np.full(256, _KINDS.index("other"), np.uint8)
    for name, chars in {
        "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789",
        "marks": ".,;:!?'\"()-", "signs": "#*$%&<>@^~=+/\\_[]{}`", "bars": "|", "spaces": " \t\r\x0b\x0c", "breaks": "\n",
    }.items():
        for c in chars:
            table[ord(c)] = _KINDS.index(name)
    return table


def statistics(text: str | None, table: np.ndarray) -> list[float]:
    """The values of ``STATISTICS`` for a text."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    kinds = np.zeros(len(_KINDS), np.int64)
    for i in range(0, len(data), _BYTES_AT_ONCE):
        kinds += np.bincount(table[np.frombuffer(data, np.uint8, min(_BYTES_AT_ONCE, len(data) - i), i)], minlength=len(_KINDS))
    n = dict(zip(_KINDS, kinds.tolist()))
    words, size = text.split(), len(data)
    lines = [x for x in text.split("\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    plain = sum(1 for x in words if x.isalpha())
    return [
        float(len(words)), sum(map(len, words)) / w, len(set(words)) / w, sum(1 for x in words if len(x) < 4) / w, plain / w,
        n["upper"] / size, n["digits"] / size, n["marks"] / size, n["signs"] / size, n["bars"] / size, n["spaces"] / size,
        float(len(lines)), len(words) / k, 1 - len(set(lines)) / k,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, words, word_length, ...)`` for every row of ``docs``."""

    def run(batches):
        table = _kind_of_byte()
        for b in batches:
            rows = [statistics(t, table) for t in texts_of(b, 1)]
            values = np.array(rows, float).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in values)], ["doc_id", *STATISTICS])

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: ``(name, above, value)``; a rule holds where all of them do."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, value in self.bounds:
            out = out & (F.col(name) > value if above else F.col(name) <= value)
        return out


def tree_rules(text: str) -> list[Rule]:
    """The paths of a tree, of every length, from the model's description."""
    rules, path = [], []
    for line in text.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = (len(m[1]) - 3) // 1
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(m[3])], m[4] == ">", float(m[5]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, above, value) in path:
            was = tightest.get((name, above), value)
            tightest[name, above] = max(was, value) if above else min(was, value)
        rules.append(Rule(tuple(sorted((name, above, v) for (name, above), v in tightest.items()))))
    return rules


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules, their weights and a bias; ``score`` is the compiled expression."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def labelled(stats: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """The statistics of all labelled rows outside the held-out fold, with ``label``."""
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, target, "int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    return stats.join(known.groupBy("doc_id").agg(F.max("label").cast("double").alias("label")), "doc_id")


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """The ensemble of labelled statistics (``STATISTICS`` and ``label``)."""
    train = stored(VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train).select("features", "label", *STATISTICS), "train")
    n, n1 = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    n1 = n1 or 0
    prior = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if n1 in (0, n):
        return RuleEnsemble((), (), prior)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED).fit(train)
    rules = list(dict.fromkeys(r for t in boosted.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        return RuleEnsemble((), (), prior)
    held = train.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("label", "features")
    sparse = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(stored(held, "rules"))
    kept = [(r, float(w)) for r, w in zip(rules, sparse.coefficients.toArray()) if w]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(sparse.intercept))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, by the ensemble fitted
    on those ``labels`` (``quality`` of each doc_id) that are not held out."""
    stats = stored(with_statistics(docs), "statistics")
    score = fit(labelled(stats, labels)).score()
    out = stats.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
