"""Merkle manifest of a dataset: a hash tree over the rows of every language, and one over the languages.

A row's leaf is the SHA-256 of its fields. Per level, the nodes of a language are read in order
through a window: fixed-offset ``lag`` and ``lead`` columns, masked by the node's slot in its run
of ``ARITY`` and by the run's length, supply its siblings, and the first row of each run hashes the
parent. Windows are cut at multiples of ``BLOCK`` (a power of ARITY), where no run is cut, so a
language that holds most rows is spread over many tasks. The siblings are handed down from the
root to the leaves, one join a level with a parent for every eight children.

Order: languages by their UTF-8 bytes, null first; rows by doc_id (null first), then leaf.

Defined cases: null fields are hashed as ``-``, so null and empty differ; rows equal in all
columns have equal leaves in neighbouring places (a proof each); rows without a doc_id are never
tampered with; a lone leaf is its language's subroot and a lone subroot is the root (proofs are
then the hash of nothing); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.llm.common import ascii_lower, column, join_groups, stored
from lexiprop.llm.shard_minimax import ordered_sums

ARITY = 8
#: Nodes that a window orders together; a power of ARITY.
BLOCK = ARITY**4


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each as ``-`` (null) or its byte count, a colon and its value."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, pos, n, digest)`` with ``before`` and ``after``: the digests of the run's other nodes."""
    near = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - F.col("pos") + slot)

    def masked(digest: Column, there: Column) -> Column:
        return F.when(there, digest).otherwise("")

    before = [masked(F.lag("digest", k).over(near), slot >= k) for k in range(ARITY - 1, 0, -1)]
    after = [masked(F.lead("digest", k).over(near), slot + k < run) for k in range(1, ARITY)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def parents(level: DataFrame) -> DataFrame:
    """The next level: the first row of each run hashes its run."""
    first = level.filter(f"n > 1 and pos % {ARITY} = 0")
    return first.select(
        "tree",
        F.floor(F.col("pos") / ARITY).alias("pos"),
        F.ceil(F.col("n") / ARITY).alias("n"),
        F.sha2(F.concat("digest", "after"), 256).alias("digest"),
    )


def levels(nodes: DataFrame, most: int, tag: str) -> list[DataFrame]:
    """All levels of trees of at most ``most`` leaves, from the leaves up, with siblings."""
    found = [stored(with_siblings(nodes), f"{tag}0")]
    while most > 1:
        found.append(stored(with_siblings(parents(found[-1])), f"{tag}{len(found)}"))
        most = -(-most // ARITY)
    return found


def roots(tree_levels: list[DataFrame]) -> DataFrame:
    """``(tree, digest)``: what remains of each tree."""
    ends = [level.filter("n = 1").select("tree", "digest") for level in tree_levels]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def paths(tree_levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``: for each level up to the root, the digests before and after the
    node on the way. ``above(tree, path)`` is what follows a tree's root."""
    known = None
    for level in reversed(tree_levels):
        out = level.filter("n = 1").join(above, "tree")
        if known is not None:
            up = known.select("tree", F.col("pos").alias("up"), F.col("path").alias("rest"))
            inner = level.filter("n > 1").withColumn("up", F.floor(F.col("pos") / ARITY)).join(up, ["tree", "up"])
            step = F.array(F.struct("before", "after"))
            out = out.unionByName(inner.withColumn("path", F.concat(step, "rest")).select(*out.columns))
        known = out
    return known


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    ``folded_root`` is computed anew from the leaf after tampering: where 3 divides the CRC-32 of
    the decimal doc_id, the text's A-Z are lower-cased.
    """
    doc_id, text = column(docs, "doc_id", "long"), column(docs, "text", "string")
    source, lang, n_chars = column(docs, "source", "string"), column(docs, "lang", "string"), column(docs, "n_chars", "long")
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = docs.select(
        doc_id.alias("doc_id"),
        lang.alias("lang"),
        leaf(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(hit, leaf(doc_id, source, lang, n_chars, ascii_lower(text))).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),  # spreads equal rows over the ranges
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("key"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = stored(rows, "leaves")
    langs = stored(rows.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "langs")
    whole = langs.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    trees, n, most = whole[0], whole[1] or 0, whole[2] or 0
    starts = stored(ordered_sums(langs, trees, ["lang"], "n"), "starts").select("key", F.col("place").alias("tree"), "n", (F.col("sum_to") - F.col("n")).alias("start"))
    placed = stored(ordered_sums(rows, n, ["lang", "doc_id", "digest", "row"], "one"), "placed")
    leaves = join_groups(placed, starts, "key", "n", n)
    leaves = leaves.select("tree", (F.col("place") - F.col("start")).alias("pos"), "n", "digest", "doc_id", "tampered")
    inner = levels(leaves, most, "tree")
    subroots = stored(roots(inner), "subroots")
    outer = levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest"), trees, "top")
    root = roots(outer).first()
    nothing = docs.sparkSession.createDataFrame([(0, [])], "tree long, path array<struct<before:string,after:string>>")
    top = paths(outer, nothing).select(F.col("pos").alias("tree"), "path", F.col("digest").alias("subroot"))
    top = stored(top, "top-paths")
    named = join_groups(paths(inner, top.select("tree", "path")), top.join(starts, "tree").select("tree", "subroot", F.col("n").alias("members")), "tree", "members", n)
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = named.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
