"""Retrieval by strategy, with fallback to keywords."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import chunking, keyword, relevance, vectors
from ..sources import kept

log = logging.getLogger(__name__)


def retrieve(docs: DataFrame, query: str, strategy: str = "keyword", top_n: int = 5, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, chunk_size: int = 2000, order: str = "similarity") -> DataFrame:
    """The ``top_n`` documents for a query by ``keyword``, ``vector`` or ``chunk`` strategy.

    vector needs embeddings (doc_id, embedding): none of them falls back to keywords, a missing query vector finds
    nothing. chunk ranks a document by its best chunk. An unknown strategy is keyword, with a warning.
    """
    if strategy == "vector":
        if embeddings is not None and not embeddings.isEmpty():
            if not query.strip() or query_vector is None:
                return docs.limit(0)
            hits = vectors.top_similar(embeddings, query_vector, top_n, "doc_id").select("doc_id", "sim")
            return vectors.hits_to_documents(hits, docs, order)
        log.warning("no embeddings; documents are ranked by keywords")
    elif strategy == "chunk":
        best = relevance.relevant_chunks(chunking.chunk_index(docs, chunk_size), query).groupBy("doc_id").agg({"score": "max"}).withColumnRenamed("max(score)", "score")
        return docs.join(best, "doc_id").orderBy(best["score"].desc(), "doc_id").limit(top_n)
    elif strategy != "keyword":
        log.warning("unknown strategy %s; documents are ranked by keywords", strategy)
    return keyword.top_documents(docs, query, top_n)


def retrieve_by_index(docs: DataFrame, query: str, root: str, store: str, embed: Callable[[list[str]], list[list[float] | None]], top_n: int = 5, order: str = "similarity", dimension: int | None = None) -> DataFrame:
    """``retrieve`` by vectors kept for ``root``; by keywords, with a warning, if the index fails or has no vectors.

    A blank query, or one that can't be embedded, finds nothing.
    """
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    try:
        held = kept.kept_vectors(docs, store, root, embed, dimension)
    except Exception as failed:  # noqa: BLE001  whatever the model raises
        log.warning("no index of %s: %s", root, failed)
        held = None
    vector = None
    if held is not None and query.strip():
        try:
            vector = embed([query])[0]
        except Exception as failed:  # noqa: BLE001
            log.warning("the query can't be embedded: %s", failed)
    return retrieve(docs, query, "vector", top_n, held, vector, order=order)
