"""Source divergence audit: how far the word use of a source differs from its language's other sources.

For each language the matrix of counts (rows: sources, columns: kept terms) becomes a K-squared
quadtree: a node stands for a quadrant with any count above zero, its children for the quadrants'
K x K parts, and its leaves hold the cells. Uniform all-zero quadrants have no node; as every
cell in them has its row's one smoothed probability, they are priced analytically, from V, the
rows' zero probabilities and how often each row has each probability (``_one_sided``). The trees
of two rows are traversed jointly from the root; only pairs of quadrants that both have counts are
entered, and their leaves correct the analytic price cell by cell. All sums are whole numbers, so
the result is exact: for rows i, j and their zero probabilities i0, j0,

    sum f(pi, pj) = V f(i0, j0) + sum_i [f(pi, j0) - f(i0, j0)] + sum_j [f(i0, pj) - f(i0, j0)]
                    + sum_both [f(pi, pj) - f(pi, j0) - f(i0, pj) + f(i0, j0)]

Defined cases: null text, lang or source reads as the empty string; a group without kept terms
has zero counts; without kept terms every pair has value 0; a lone source has no pairs; repeated
rows count each time; an empty table gives no rows; other columns are ignored. Counts may grow to
9e15 (three decimal digits of a probability are divided at a time).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.llm.common import column, join_groups, stored
from lexiprop.llm.shard_minimax import ordered_sums

#: Bytes of UTF-8: ASCII letters in lower case and the bytes of other characters; all else ends a term.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are split at once, and terms that a task holds.
PIECE, MOST_TERMS = 1 << 22, 600_000
COUNT_COLUMNS = ["lang", "source", "term", "n", "d"]
COUNT_KINDS = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
MIN_DOCS = 10
TOP_TERMS = 10
#: A node of the quadtree has K x K children; a leaf holds K x K cells.
K = 16
#: Probabilities that one row of the one-sided prices holds, about.
CHUNK = 1024


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, n: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (n + 2 terms))``, by long division, three digits a step."""
    bottom = n + 2 * terms
    rest, digits = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        digits = digits * 1000 + _div(rest * 1000, bottom)
        rest = (rest * 1000) % bottom
    return digits + 1


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``."""
    return _div((p - q) * (p - q), p + q)


def pieces(text: bytes):
    """The terms of a text (UTF-8), some megabytes at a time."""
    clean = text.translate(LETTERS)
    start = 0
    while start < len(clean):
        end = clean.find(b" ", start + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def count_terms(batches):
    """Counts of the rows ``(lang, source, text)`` of a task; written out whenever it holds MOST_TERMS."""

    def held(counts):
        for (lang, source), (n, d) in counts.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), terms, [n[t] for t in terms], [d[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, COUNT_KINDS)], names=COUNT_COLUMNS)

    counts, size = defaultdict(lambda: (Counter(), Counter())), 0
    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, batch.column(2)):
            n, d = counts[group]
            size -= len(n)
            seen: set[bytes] = set()
            for terms in pieces(text.as_py()):
                n.update(terms)
                seen.update(terms)
            d.update(seen)
            size += len(n)
            if size > MOST_TERMS:
                yield from held(counts)
                counts.clear()
                size = 0
    yield from held(counts)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)``: occurrences, and documents with the term.

    Tasks count in Python (a tenth of the time of grouping every term in the JVM) and add up before the shuffle.
    """
    texts = docs.select(*_group(docs), F.coalesce(column(docs, "text", "string"), F.lit("")).cast("binary").alias("text"))
    schema = "lang string, source string, term binary, n long, d long"
    parts = texts.mapInArrow(count_terms, schema).withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.sum("d").alias("docs"))


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(column(docs, c, "string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _starts(parts: DataFrame, n: int) -> DataFrame:
    """``(lang, total, start)``: what ``parts(lang, total)`` of the languages before sum up to."""
    sums = ordered_sums(parts, n, ["lang"], "total")
    return sums.select("lang", "total", (F.col("sum_to") - F.col("total")).alias("start"))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) among the rows of the same lang, and ``total``, how many it has."""
    rows = stored(rows.withColumn("one", F.lit(1).cast("long")), name)
    parts = stored(rows.groupBy("lang").agg(F.sum("one").alias("total")), f"{name}-langs")
    langs, n = parts.agg(F.count(F.lit(1)), F.sum("total")).first()
    placed = ordered_sums(rows, n or 0, ["lang", *order], "one")
    joined = join_groups(placed, _starts(parts, langs), "lang", "total", n or 0)
    return joined.withColumn(name, F.col("place") - F.col("start")).drop("one", "sum_to", "place", "start")


class CountMatrix:
    """The stored matrix of counts: ``cells``, ``groups`` (one row a source of a language) and its quadtree."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, k: int = K):
        self.k = k
        counts = stored(term_counts(docs), "term-counts")
        totals = counts.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"))
        terms = stored(_numbered(totals.filter(F.col("docs") >= min_docs).drop("docs"), ["term"], "col"), "terms")
        kept = stored(counts.drop("docs").join(terms.drop("total"), ["lang", "term"]), "kept-counts")
        own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("cells"))
        whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("n_lang"))
        groups = _numbered(docs.select(*_group(docs)).distinct(), ["source"], "row").withColumnRenamed("total", "sources")
        # one row a language on the other side; a language with most of the groups is split by AQE
        groups = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "cells", "v", "n_lang"])
        zero = F.when(F.col("v") > 0, probability(F.lit(0), F.col("n"), F.col("v")))
        self.groups = stored(groups.withColumn("p0", zero), "groups")
        facts = self.groups.filter("cells > 0").select("lang", "source", "row", "n", "v", "n_lang", "p0", F.col("cells").alias("members"))
        cells = join_groups(kept, facts, ["lang", "source"], "members", kept.count())
        p, q = probability(F.col("count"), F.col("n"), F.col("v")), probability(F.col("in_lang"), F.col("n_lang"), F.col("v"))
        self.cells = stored(cells.select("lang", "source", "row", "term", "col", p.alias("p"), q.alias("q"), "p0"), "cells")
        sides = self.groups.agg(F.max("sources"), F.max("v")).first()
        self.depth = 1
        while k**self.depth < max(sides[0] or 0, sides[1] or 0):
            self.depth += 1

    def quadrants(self, level: int) -> DataFrame:
        """``(lang, r, c)``: the quadrants of side ``k ** level`` that have a count."""
        side = F.lit(self.k**level)
        return self.cells.select("lang", F.floor(F.col("row") / side).alias("r"), F.floor(F.col("col") / side).alias("c")).distinct()

    def leaves(self) -> DataFrame:
        """The leaf quadrants' cells: ``(lang, r, c, col, row, p, p0)``, at most K x K for each (lang, r, c)."""
        r, c = F.floor(F.col("row") / self.k), F.floor(F.col("col") / self.k)
        return self.cells.select("lang", r.alias("r"), c.alias("c"), "col", "row", "p", "p0")

    def leaf_pairs(self) -> DataFrame:
        """``(lang, a, b, c)``: leaf quadrants of rows a <= b and the same columns that both have counts,
        found by entering the trees jointly from the root."""
        pairs = self.quadrants(self.depth).select("lang", F.col("r").alias("a"), F.col("r").alias("b"), "c")
        for level in range(self.depth - 1, 0, -1):
            nodes = stored(self.quadrants(level), f"quadrants{level}")
            up = lambda c: F.floor(F.col(c) / self.k)
            left = nodes.select("lang", up("r").alias("a"), up("c").alias("c"), F.col("r").alias("a1"), F.col("c").alias("c1"))
            right = nodes.select("lang", F.col("r").alias("b1"), up("r").alias("b"), F.col("c").alias("c1"))
            pairs = pairs.join(left, ["lang", "a", "c"]).join(right, ["lang", "b", "c1"]).filter("a1 <= b1")
            pairs = pairs.select("lang", F.col("a1").alias("a"), F.col("b1").alias("b"), F.col("c1").alias("c"))
        return pairs


def _both_sided(matrix: CountMatrix) -> DataFrame:
    """Corrections ``(lang, i, j, value)`` of cells that both rows count, from the leaves."""
    leaves = matrix.leaves()
    left = leaves.select("lang", F.col("r").alias("a"), "c", "col", F.col("row").alias("i"), F.col("p").alias("xp"), F.col("p0").alias("x0"))
    right = leaves.select("lang", F.col("r").alias("b"), "c", "col", F.col("row").alias("j"), F.col("p").alias("yp"), F.col("p0").alias("y0"))
    cells = matrix.leaf_pairs().join(left, ["lang", "a", "c"]).join(right, ["lang", "b", "c", "col"]).filter("i < j")
    xp, x0, yp, y0 = (F.col(c) for c in ("xp", "x0", "yp", "y0"))
    value = divergence(xp, yp) - divergence(xp, y0) - divergence(x0, yp) + divergence(x0, y0)
    return cells.groupBy("lang", "i", "j").agg(F.sum(value).alias("value"))


def _one_sided(matrix: CountMatrix, others: DataFrame) -> DataFrame:
    """``(lang, i, j, value)``: a row's counted cells against the other's zeros, beyond ``f(i0, j0)`` each.

    Each of the row's probabilities is priced once, times how often it has it.
    """
    often = matrix.cells.groupBy("lang", "row", "p").agg(F.count(F.lit(1)).alias("times"))
    sizes = often.groupBy("lang", "row").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    often = often.join(sizes, ["lang", "row"])
    chunks = often.groupBy("lang", "row", F.pmod(F.xxhash64("p"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("p", "times")).alias("often"))
    pairs = others.join(chunks.withColumnRenamed("row", "i"), ["lang", "i"])
    i0, j0 = F.col("i0"), F.col("j0")
    value = F.aggregate("often", F.lit(0).cast("long"), lambda s, x: s + x["times"] * (divergence(x["p"], j0) - divergence(i0, j0)))
    return pairs.select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), value.alias("value"))


def pair_values(matrix: CountMatrix) -> DataFrame:
    """``(lang, source, item, value)`` for both orders of every pair of a language's sources."""
    g = matrix.groups
    mine = g.filter("sources > 1").select("lang", F.col("row").alias("i"), F.col("source").alias("name_i"), F.col("p0").alias("i0"), "v", F.explode(F.expr("sequence(0L, sources - 1)")).alias("j"))
    other = g.select("lang", F.col("row").alias("j"), F.col("source").alias("name_j"), F.col("p0").alias("j0"))
    ordered = stored(mine.filter("i != j").join(other, ["lang", "j"]), "source-pairs")
    zeros = ordered.filter("i < j").select("lang", "i", "j", F.coalesce(F.col("v") * divergence(F.col("i0"), F.col("j0")), F.lit(0)).alias("value"))
    parts = zeros.unionByName(_one_sided(matrix, ordered)).unionByName(_both_sided(matrix))
    sums = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    names = ordered.filter("i < j").select("lang", "i", "j", "name_i", "name_j")
    both = sums.join(names, ["lang", "i", "j"])
    two = F.array(F.struct(F.col("name_i").alias("source"), F.col("name_j").alias("item")), F.struct(F.col("name_j").alias("source"), F.col("name_i").alias("item")))
    return both.select("lang", F.explode(two).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every other source (part ``pair``) by divergence,
    and the ``top`` terms that a source uses more than its language (part ``term``)."""
    matrix = CountMatrix(docs, min_docs)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(matrix).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by))
    terms = matrix.cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
