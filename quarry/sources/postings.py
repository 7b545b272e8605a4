"""An inverted index of chunks: postings in folders by the hash of their term, read for the asked terms only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relevance

POSTINGS, CHUNKS, META = "postings", "chunks", "meta"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = 256, dealt: bool = True) -> None:
    """Write a chunk index (doc_id, chunk_ix, tokens, tfidf) as postings (term, doc_id, chunk_ix, weight) and chunks (tokens).

    A posting's weight is null for a token without TF-IDF. Rows are dealt by ranges of bucket, term and chunk, so a term
    that is in most chunks spans several tasks and files, and a file's terms lie together for its statistics. With
    ``dealt`` false each task writes its own rows, a file a bucket in the same order, and nothing is exchanged: for an
    index in few partitions.
    """
    each = F.explode(F.array_distinct(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.coalesce(F.map_keys("tfidf"), F.array().cast("array<string>")))))
    rows = index.select("doc_id", "chunk_ix", "tfidf", each.alias("term")).select(
        "term", "doc_id", "chunk_ix", F.try_element_at("tfidf", F.col("term")).alias("weight"), bucket_of(F.col("term"), buckets).alias("bucket"))
    order = ["bucket", "term", "doc_id", "chunk_ix"]
    chunks = index.select("doc_id", "chunk_ix", "tokens", bucket_of(F.col("doc_id"), buckets).alias("bucket"))
    if dealt:
        rows, chunks = rows.repartitionByRange(*order), chunks.repartitionByRange("bucket", "doc_id", "chunk_ix")
    rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{POSTINGS}")
    write = chunks.write.mode("overwrite").partitionBy("bucket") if dealt else chunks.drop("bucket").write.mode("overwrite")
    write.parquet(f"{path}/{CHUNKS}")
    index.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}/{META}")


def postings_of(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the terms: only their buckets' folders are read, and only files whose terms may hold them."""
    buckets = spark.read.json(f"{path}/{META}").first()["buckets"]
    asked = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    homes = spark.range(1).select(F.array_distinct(F.transform(asked, lambda t: bucket_of(t, buckets))).alias("b")).first()["b"]
    return spark.read.parquet(f"{path}/{POSTINGS}").filter(F.col("bucket").isin(homes) & F.col("term").isin(list(dict.fromkeys(terms)))).drop("bucket")


def base_scores(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """doc_id, chunk_ix, base of the chunks that hold a word, as ``relevance.base_score`` of them: no chunk is read."""
    times = F.create_map(*(F.lit(x) for pair in Counter(words).items() for x in pair)) if words else None
    rows = postings_of(spark, path, words)
    if times is None:
        return rows.select("doc_id", "chunk_ix", F.lit(0.0).alias("base"))
    points = F.coalesce(F.col("weight") * relevance.TERM_WEIGHT, F.element_at(times, F.col("term")) * relevance.OVERLAP)
    return rows.groupBy("doc_id", "chunk_ix").agg(F.sum(points).alias("base")).filter("base > 0")


def relevant_chunks(spark: SparkSession, path: str, query: str, top_n: int | None = None) -> DataFrame:
    """doc_id, chunk_ix, tokens, score as ``relevance.relevant_chunks`` of the written index.

    With ``top_n``, chunks whose base can't reach the ``top_n``-th even with the full bonus are left out before their
    tokens are read.
    """
    words = relevance.query_tokens(spark, query)
    hit = base_scores(spark, path, words)
    chunks = spark.read.parquet(f"{path}/{CHUNKS}").drop("bucket")
    if not words:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    if top_n is not None and top_n > 0:
        lowest = hit.orderBy(F.desc("base")).limit(top_n).agg(F.min("base").alias("least"), F.count("*").alias("n")).first()
        if lowest["n"] == top_n:
            hit = hit.filter(F.col("base") * (1 + relevance.BONUS) >= F.lit(lowest["least"]))
    return relevance.ranked(chunks.join(hit, ["doc_id", "chunk_ix"]), words, top_n)
