"""End-to-end compositions of the operators: graph -> split -> seeds -> diffusion -> evaluation.

Each function is lazy except where the graph is materialised to the
checkpoint folder (it is read once per diffusion step).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.functions.text import DEFAULT_CORPUS_ACTIONS
from lexiprop.operators import evaluate as ev
from lexiprop.operators.corpus import clean_corpus, line_mode, sentences, stream_chunks
from lexiprop.operators.embed import train_embeddings
from lexiprop.operators.thesaurus import DEFAULT_THESAURUS_ACTIONS, clean_thesaurus
from lexiprop.operators import graph as gr
from lexiprop.operators import propagate as pr
from lexiprop.operators import splits as sp
from lexiprop.session import cut_lineage


@dataclass
class GraphOptions:
    variant: str = "knn"
    n_neighbors: int = 3
    radius: float = 0.1
    mode: str = "connectivity"
    include_self: bool = False
    force_symmetric: bool = True


@dataclass
class SplitOptions:
    variant: str = "sample_each_concept_frac"
    frac: float = 0.5
    n_test: int = 1
    seeds: Sequence[int] = field(default_factory=lambda: (1,))


@dataclass
class DiffusionOptions:
    method: str = "label_propagation"
    iterations: int = 3
    alpha: float = 0.2
    checkpoint_every: int = 5


def build_graph(vectors: DataFrame, opts: GraphOptions, materialize: bool = False) -> DataFrame:
    nv = gr.normalize_vectors(vectors.select("word", "vector"))
    edges = gr.build_graph(
        nv,
        opts.variant,
        n_neighbors=opts.n_neighbors,
        radius=opts.radius,
        mode=opts.mode,
        include_self=opts.include_self,
        force_symmetric=opts.force_symmetric,
    )
    return cut_lineage(edges) if materialize else edges


def expand_thesaurus(
    vectors: DataFrame,
    thesaurus: DataFrame,
    graph: GraphOptions | None = None,
    split: SplitOptions | None = None,
    diffusion: DiffusionOptions | None = None,
    materialize_graph: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Stages 3 and 5-8: returns ``(evaluation_table, split)``.

    ``vectors``: ``(word, vector)``; ``thesaurus``: ``(word, synset)``.
    """
    graph = graph or GraphOptions()
    split = split or SplitOptions()
    diffusion = diffusion or DiffusionOptions()
    edges = build_graph(vectors, graph, materialize_graph)
    # the split feeds the seeds of every step and the evaluation: written once
    parts = cut_lineage(
        sp.split_thesaurus(
            thesaurus.select("word", "synset"), split.variant, frac=split.frac, n_test=split.n_test, seeds=split.seeds
        )
    )
    labels = pr.seed_labels(vectors.select("word"), sp.train_part(parts), split.seeds)
    predictions = pr.propagate(
        edges, labels, diffusion.method, diffusion.iterations, diffusion.alpha, diffusion.checkpoint_every
    )
    return ev.evaluation_table(predictions, parts), parts


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (output convention for oracle checks)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            # round to 12 decimals first: summation-order noise (1e-16) near a rounding
            # boundary then lands on the boundary itself in every engine
            cols.append(F.round(F.round(F.col(f.name), 12), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@dataclass
class CorpusOptions:
    actions: Sequence[str] = field(default_factory=lambda: tuple(DEFAULT_CORPUS_ACTIONS))
    max_texts: int | None = None


@dataclass
class EmbeddingOptions:
    method: str = "fasttext"
    size: int = 100
    window: int = 5
    iter: int = 5
    seed: int = 1


def expand_from_corpus(
    corpus: DataFrame,
    concepts: DataFrame,
    corpus_opts: CorpusOptions | None = None,
    embedding: EmbeddingOptions | None = None,
    thesaurus_actions: Sequence[str] = DEFAULT_THESAURUS_ACTIONS,
    graph: GraphOptions | None = None,
    split: SplitOptions | None = None,
    diffusion: DiffusionOptions | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All eight stages: clean the corpus, train embeddings, build the graph, clean the
    thesaurus against the embedding vocabulary, split, diffuse and evaluate.

    ``corpus``: ``(doc_id, text)``; ``concepts``: ``(concept, pos, class, keys)``.
    Returns ``(evaluation_table, split)``.  The embeddings are written to the
    checkpoint folder once (graph, vocabulary and thesaurus all read them).
    """
    corpus_opts = corpus_opts or CorpusOptions()
    embedding = embedding or EmbeddingOptions()
    clean = clean_corpus(corpus, corpus_opts.actions, max_texts=corpus_opts.max_texts)
    sents = sentences(clean, corpus_opts.actions)
    stream = None
    if embedding.method == "glove" and line_mode(corpus_opts.actions) == "single":
        # windows run over the whole line; only the sentences of the other trainers are cut
        stream = stream_chunks(clean).select(F.lit(0).alias("doc_id"), F.col("gpos").alias("pos"), "token")
    vectors = train_embeddings(
        embedding.method, sents, size=embedding.size, window=embedding.window, iter=embedding.iter, seed=embedding.seed, stream=stream
    )
    vectors = cut_lineage(vectors)
    thesaurus = clean_thesaurus(concepts, vectors.select("word"), thesaurus_actions)
    return expand_thesaurus(vectors, thesaurus, graph, split, diffusion)
