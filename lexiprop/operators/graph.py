"""Similarity graph construction and normalisation.

Edges are a long table ``(src, dst, weight double)`` keyed on the word itself,
never on a row number, so nothing needs a global index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.functions.vectors import l2_normalize
from lexiprop.operators.similarity import DEFAULT_BLOCK_ROWS, similarity_join

MODES = ("connectivity", "distance")
VARIANTS = ("knn", "radius")


def normalize_vectors(vectors: DataFrame, vec: str = "vector") -> DataFrame:
    """L2-normalise a vector column (cast to double first)."""
    return vectors.withColumn(vec, l2_normalize(F.col(vec).cast("array<double>")))


def _weights(pairs: DataFrame, mode: str, include_self: bool) -> DataFrame:
    if mode == "connectivity":
        # G4
        weight = F.lit(1.0)
    elif mode == "distance":
        # 1 - d^2/2, the cosine similarity for unit vectors
        weight = F.lit(1.0) - F.col("score") * F.col("score") / 2.0
    else:
        raise NotImplementedError(mode)
    edges = pairs.select("src", "dst", weight.alias("weight"))
    if mode == "distance" and not include_self:
        # No self loop (and no stored zero) in distance mode
        edges = edges.filter(F.col("src") != F.col("dst"))
    return edges


def knn_graph(
    vectors: DataFrame,
    *,
    word: str = "word",
    vec: str = "vector",
    n_neighbors: int = 3,
    mode: str = "connectivity",
    include_self: bool = False,
    force_symmetric: bool = True,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """G1 (+G3-G7): directed edges to the k nearest neighbours by Euclidean distance."""
    pairs = similarity_join(
        vectors,
        vectors,
        left_id=word,
        right_id=word,
        vec=vec,
        metric="euclidean",
        k=n_neighbors,
        exclude_same_id=not include_self,
        block_rows=block_rows,
    )
    edges = _weights(pairs, mode, include_self)
    return symmetrize(edges) if force_symmetric else edges


def radius_graph(
    vectors: DataFrame,
    *,
    word: str = "word",
    vec: str = "vector",
    radius: float = 0.1,
    mode: str = "connectivity",
    include_self: bool = False,
    force_symmetric: bool = True,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """G2 (+G3-G7): every pair within Euclidean distance ``radius``."""
    pairs = similarity_join(
        vectors,
        vectors,
        left_id=word,
        right_id=word,
        vec=vec,
        metric="euclidean",
        radius=radius,
        exclude_same_id=not include_self,
        block_rows=block_rows,
    )
    edges = _weights(pairs, mode, include_self)
    if not force_symmetric:
        return edges
    # a radius finds each pair from both ends with the same distance, so the graph is symmetric already;
    # only a word with several vectors leaves edges to put together
    return edges.filter(F.col("weight") != 0.0) if _unique(vectors, word) else symmetrize(edges)


def _unique(vectors: DataFrame, word: str) -> bool:
    """Whether no word comes twice and none is null."""
    rows, words = vectors.agg(F.count(F.lit(1)), F.countDistinct(word)).first()
    return rows == words


def build_graph(vectors: DataFrame, variant: str = "knn", **options) -> DataFrame:
    """Graph stage with the reference's variant switch (unknown variant raises)."""
    if variant == "knn":
        options.pop("radius", None)
        return knn_graph(vectors, **options)
    if variant == "radius":
        options.pop("n_neighbors", None)
        return radius_graph(vectors, **options)
    raise NotImplementedError(variant)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Elementwise max(A, A^T) where a missing edge counts as 0; zeros dropped.

    One aggregation over the edges and their reverses: partial aggregation
    combines map-side, so hub nodes do not create a hot reducer.
    """
    # both directions from one read of the edges (no union: the input is often a UDF result)
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("weight").alias("weight")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("weight")),
            )
        ).alias("e")
    ).select("e.*")
    agg = both.groupBy("src", "dst").agg(F.max("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    sym = agg.select(
        "src",
        "dst",
        F.when(F.col("n") >= 2, F.col("w")).otherwise(F.greatest(F.col("w"), F.lit(0.0))).alias("weight"),
    )
    return sym.filter(F.col("weight") != 0.0)


def _keys(edges: DataFrame) -> list[str]:
    """Extra key columns of a per-split graph (``split_id``), empty for a shared graph."""
    return ["split_id"] if "split_id" in edges.columns else []


def degrees(edges: DataFrame) -> DataFrame:
    """L3: row sums of the weights."""
    return edges.groupBy(*_keys(edges), "src").agg(F.sum("weight").alias("degree"))


def transition(edges: DataFrame) -> DataFrame:
    """L4: row-normalised P = D^-1 A (degree by aggregation + join, skew-safe)."""
    keys = _keys(edges)
    deg = degrees(edges)
    return edges.join(deg, [*keys, "src"]).select(
        *keys, "src", "dst", F.try_divide(F.col("weight"), F.col("degree")).alias("p")
    )


def symmetric_normalized(edges: DataFrame) -> DataFrame:
    """S = D^-1/2 A D^-1/2 with row-sum degrees on both sides."""
    keys = _keys(edges)
    deg = degrees(edges)
    ds = deg.select(*keys, F.col("src"), F.col("degree").alias("d_src"))
    dd = deg.select(*keys, F.col("src").alias("dst"), F.col("degree").alias("d_dst"))
    joined = edges.join(ds, [*keys, "src"]).join(dd, [*keys, "dst"])
    return joined.select(
        *keys,
        "src",
        "dst",
        F.try_divide(F.col("weight"), F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("s"),
    )
