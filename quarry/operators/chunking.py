"""Chunking at headings, greedy packing, token statistics and TF-IDF of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MARK = "\u0001"
#: Characters of text whose tokens a task holds as rows at once, about; documents that a task weighs at once.
TASK_CHARS, SLICE = 4_000_000, 256
HEADING = "(?md)^(#{1,6}\\s+.+|={3,}|-{3,})$"


def heading_parts(content: Column) -> Column:
    """Text between heading lines, and the heading lines, in order; blank parts are left out."""
    marked = F.regexp_replace(F.replace(content, F.lit(MARK), F.lit("")), HEADING, f"{MARK}$1{MARK}")
    return F.filter(F.split(marked, MARK), lambda p: ~T.is_blank(p))


def packed(parts: Column, size: int, joint: str, joint_counts: bool) -> Column:
    """Parts joined greedily: a part that would pass ``size`` starts the next chunk. Joints count only if asked."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("int").alias("n"), F.lit(False).alias("open"))

    def step(acc: Column, part: Column) -> Column:
        full = acc["open"] & (acc["n"] + F.length(part) > size)
        now = F.when(acc["open"] & ~full, F.concat(acc["now"], F.lit(joint), part)).otherwise(part)
        n = F.length(now) if joint_counts else F.when(full | ~acc["open"], F.length(part)).otherwise(acc["n"] + F.length(part))
        is_open = (F.length(now) > 0) if joint_counts else F.lit(True)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), now.alias("now"), n.cast("int").alias("n"), is_open.alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"], F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))


def chunk_texts(content: Column, size: int = 2000) -> Column:
    """Chunks of about ``size`` characters; those over half as much again are cut at blank lines and packed anew."""
    first = packed(heading_parts(content), size, "\n", False)
    cut = lambda c: F.when(F.length(c) <= size * 1.5, F.array(c)).otherwise(packed(F.split(c, "(?U)\\n\\s*\\n"), size, "\n\n", True))
    return F.filter(F.flatten(F.transform(first, cut)), lambda c: ~T.is_blank(c))


def chunks(docs: DataFrame, size: int = 2000) -> DataFrame:
    """doc_id, chunk_ix, approx_offset, text of docs (doc_id, content). The offset is the sum of earlier lengths, one more each."""
    rows = docs.select("doc_id", F.posexplode(chunk_texts(F.col("content"), size)).alias("chunk_ix", "text"))
    before = Window.partitionBy("doc_id").orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("approx_offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def approx_chunk_count(content: Column, size: int = 2000) -> Column:
    return F.floor(F.length(content) / size)


def tasks_of(rows: DataFrame, text: str = "text") -> int:
    """How many tasks to deal texts to, so that what one of them holds as tokens doesn't grow with the table. Reads the texts once."""
    chars = rows.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))


def token_counts(chunked: DataFrame, tasks: int | None = None, whole_docs: bool = False) -> DataFrame:
    """doc_id, chunk_ix, term, n, size (tokens of the chunk).

    Chunks are dealt out before they are cut into tokens, so texts are exchanged instead of a row a token, and counting
    needs no exchange of its own. With ``whole_docs``, what is then counted by document doesn't need one either.
    """
    by = ["doc_id"] if whole_docs else ["doc_id", "chunk_ix"]
    return counted(chunked.select("doc_id", "chunk_ix", "text").repartition(tasks or tasks_of(chunked), *by), [])


def counted(chunked: DataFrame, also: list[str]) -> DataFrame:
    listed = chunked.withColumn("tokens", T.tokens(F.col("text"))).select("doc_id", "chunk_ix", "tokens", *also)
    each = listed.select("doc_id", "chunk_ix", F.size("tokens").alias("size"), F.explode("tokens").alias("term"), *also)
    return each.groupBy("doc_id", "chunk_ix", "term", "size", *also).agg(F.count("*").alias("n"))


def tfidf(chunked: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, chunk_ix, term, tf, df, idf, weight; a document's chunks are the corpus, so one exchange by document serves all."""
    dealt = chunked.select("doc_id", "chunk_ix", "text").repartition(tasks or tasks_of(chunked), "doc_id")
    total = dealt.withColumn("chunks", F.count("*").over(Window.partitionBy("doc_id")))
    rows = counted(total, ["chunks"]).withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "term")))
    rows = rows.withColumns({"tf": F.col("n") / F.col("size"), "idf": F.log((F.col("chunks") + 1) / (F.col("df") + 1)) + 1})
    return rows.select("doc_id", "chunk_ix", "term", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def chunk_index(docs: DataFrame, size: int = 2000) -> DataFrame:
    """doc_id, chunk_ix, approx_offset, text, tokens, tfidf (map of term to weight)."""
    return indexed(chunks(docs, size), tasks_of(docs, "content"))


def indexed(made: DataFrame, tasks: int | None = None) -> DataFrame:
    """Chunks (doc_id, chunk_ix, text) with tokens and tfidf."""
    tasks, keys = tasks or tasks_of(made), ["doc_id", "chunk_ix"]
    maps = tfidf(made, tasks).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("tfidf"))
    return made.repartition(tasks, *keys).withColumn("tokens", T.tokens(F.col("text"))).join(maps.repartition(tasks, *keys), keys, "left")


def weights(tokens: pa.ListArray) -> pa.MapArray:
    """The TF-IDF of each chunk, null without tokens; tokens: a list of chunks' tokens for each document."""
    chunks = tokens.flatten()
    coded, sizes = chunks.flatten().dictionary_encode(), chunks.value_lengths().to_numpy(zero_copy_only=False)
    doc_sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    terms, docs = max(1, len(coded.dictionary)), np.repeat(np.arange(len(doc_sizes)), doc_sizes)
    each, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    chunk, term = np.divmod(each, terms)
    _, at, df = np.unique(docs[chunk] * terms + term, return_inverse=True, return_counts=True)
    weight = n / sizes[chunk] * (np.log((doc_sizes[docs[chunk]] + 1) / (df[at] + 1)) + 1)
    ends = np.searchsorted(chunk, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(ends, mask=np.append(sizes == 0, False)), coded.dictionary.take(pa.array(term)), pa.array(weight))


def indexed_whole(docs: DataFrame, chunks: Column) -> DataFrame:
    """doc_id, chunk_ix, tokens, tfidf of docs as ``indexed`` has them, where each doc_id has one row with its list of chunk texts.

    A document is weighed in the task that reads it, so nothing is exchanged.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = docs.select("doc_id", F.transform(chunks, lambda x: F.coalesce(T.tokens(x), F.array().cast("array<string>"))).alias("tokens"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, tokens = batch.slice(at, SLICE).columns
                sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ix = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(ix.astype(np.int32)), tokens.flatten(), weights(tokens)], ["doc_id", "chunk_ix", "tokens", "tfidf"])

    return listed.mapInArrow(weighed, f"doc_id {kind}, chunk_ix int, tokens array<string>, tfidf map<string,double>")
