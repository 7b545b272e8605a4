"""Relevance of chunks: TF-IDF of matching terms, overlap of others, and a bonus for similar sequences."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TERM_WEIGHT, OVERLAP, BONUS = 1.5, 0.5, 0.3


def query_tokens(spark, query: str) -> list[str]:
    return spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first()["t"]


def sequence_ratio(query: list[str]):
    """A function of token arrays: the ratio of matching blocks with the query's tokens."""

    @F.pandas_udf("double")
    def ratio(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: SequenceMatcher(None, query, list(t) if t is not None else []).ratio())

    return ratio


def base_score(tokens: Column, tfidf: Column, query: list[str]) -> Column:
    terms = F.array(*(F.lit(t) for t in dict.fromkeys(query)))
    weights = F.coalesce(tfidf, F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>")))
    matched = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weights, t), F.lit(0.0)) * TERM_WEIGHT)
    words = F.array(*map(F.lit, query))
    more = F.size(F.filter(words, lambda t: F.array_contains(tokens, t) & ~F.map_contains_key(weights, t)))
    return matched + more * OVERLAP


def ratio_bound(tokens: Column, query: list[str]) -> Column:
    """At least the ratio of matching blocks: twice the tokens in common, as a multiset, over all tokens."""
    words = F.coalesce(tokens, F.array().cast("array<string>"))
    held = lambda t: F.size(F.filter(words, lambda x: x == F.lit(t)))
    common = [F.least(held(t), F.lit(n)) for t, n in Counter(query).items()]
    return 2.0 * sum(common[1:], common[0]) / (F.size(words) + F.lit(len(query)))


def contenders(hit: DataFrame, query: list[str], top_n: int) -> DataFrame:
    """Rows of ``hit`` (base, tokens) that can be among the best ``top_n``: their bound reaches the ``top_n``-th base score."""
    lowest = hit.select("base").orderBy(F.desc("base")).limit(top_n).agg(F.min("base").alias("least"), F.count("*").alias("n")).first()
    if lowest["n"] < top_n:
        return hit
    near = hit.filter(F.col("base") * (1 + BONUS) >= F.lit(lowest["least"]))  # before the tokens are counted
    return near.filter(F.col("base") * (1 + ratio_bound(F.col("tokens"), query) * BONUS) >= F.lit(lowest["least"]))


def ranked(hit: DataFrame, query: list[str], top_n: int | None) -> DataFrame:
    """Rows of ``hit`` (base, tokens) with score, best first; ties in the order of doc_id and chunk."""
    if top_n is not None:
        if top_n <= 0:
            return hit.withColumn("score", F.lit(0.0)).drop("base").limit(0)
        hit = contenders(hit, query, top_n)
    scored = hit.withColumn("score", F.col("base") * (1 + sequence_ratio(query)(F.col("tokens")) * BONUS)).drop("base")
    ordered = scored.orderBy(F.desc("score"), "doc_id", "chunk_ix")
    return ordered if top_n is None else ordered.limit(top_n)


def relevant_chunks(index: DataFrame, query: str, top_n: int | None = None) -> DataFrame:
    """Chunks of an index (tokens, tfidf) with a score above 0, best first; ties in the order of doc_id and chunk.

    A query without tokens finds nothing. Only chunks with a base score reach the sequence comparison, and with ``top_n``
    only those whose bound is not below the ``top_n``-th base score.
    """
    words = query_tokens(index.sparkSession, query)
    if not words:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    hit = index.withColumn("base", base_score(F.col("tokens"), F.col("tfidf"), words)).filter(F.col("base") > 0)
    return ranked(hit, words, top_n)
