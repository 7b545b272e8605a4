"""Indexes kept in a folder and brought up to date by what has changed: chunks of files, and vectors of documents.

A refresh writes a segment with what is new, then a manifest that says which segment holds what. Readers take the last
finished manifest, so a refresh that fails changes nothing. One refresh of a store runs at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from . import scan
from .shared import delete, exists, file_system

SIDECAR = ".chunks.jsonl"
MANIFEST = "name string, length long, modified timestamp, sha256 string, error string, segment int"
SEGMENT = "doc_id string, chunk_ix int, offset long, text string, tokens array<string>, tfidf map<string,double>, segment int"
VECTORS = "doc_id string, digest string, embedding array<double>"
#: Segments after which a refresh writes all that is still valid as one.
MOST_SEGMENTS = 8


@dataclass
class Refreshed:
    """What a refresh has done: files in the index, files read for it, files gone since, files that can't be read."""

    files: int
    read: int
    removed: int
    failed: int


def versions(spark: SparkSession, store: str, kind: str) -> list[int]:
    """Numbers of the finished manifests or vector tables of a store, in order."""
    fs, top = file_system(spark, store)
    if not fs.exists(top):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{kind}-") and exists(spark, f"{store}/{n}/_SUCCESS"))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The store's last manifest: name, length, modified, sha256, error, segment."""
    found = versions(spark, store, "manifest") if version is None else [version]
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest-{found[-1]}") if found else spark.createDataFrame([], MANIFEST)


def kept_chunks(spark: SparkSession, store: str) -> DataFrame:
    """doc_id (the name), chunk_ix, offset, text, tokens, tfidf of all files in the index."""
    known = manifest(spark, store).filter("error IS NULL").select(F.col("name").alias("doc_id"), "segment")
    segments = [r.segment for r in known.select("segment").distinct().collect()]  # MOST_SEGMENTS at most
    paths = [p for k in segments if exists(spark, p := f"{store}/segment-{k}")]
    if not paths:
        return spark.createDataFrame([], SEGMENT).drop("segment")
    return spark.read.schema(SEGMENT).parquet(*paths).join(known, ["doc_id", "segment"], "left_semi").drop("segment")


def refresh_chunks(spark: SparkSession, root: str, store: str, size: int = 2000, opener: scan.Opener | None = None, most_segments: int = MOST_SEGMENTS) -> Refreshed:
    """Bring the chunk index of a folder's files up to date; only files of a new length or time are read.

    Sidecars and names with a question mark don't count. A file that can't be read is noted and tried again next time.
    Another chunk size reads all anew.
    """
    store = f"{store.rstrip('/')}/{hashlib.sha256(f'{root.rstrip("/")}:{size}'.encode()).hexdigest()[:16]}"
    now = scan.listed(spark, root).filter(~F.contains("name", F.lit("?")) & ~F.endswith("name", F.lit(SIDECAR)))
    done = versions(spark, store, "manifest")
    last, version = manifest(spark, store), (done[-1] + 1 if done else 0)
    same = [now["name"] == last["name"], now["length"] == last["length"], now["modified"] == last["modified"], last["error"].isNull(), now["error"].isNull()]
    valid = last.join(now, same, "left_semi")
    changed = now.join(last, same, "left_anti")
    gone = last.join(now, "name", "left_anti").count()
    todo = changed.count()
    if todo or gone:
        if todo:
            contents = f"{store}/contents-{version}"
            scan.read_each(changed, root, whole=True, opener=opener).write.mode("overwrite").parquet(contents)
            read = spark.read.parquet(contents)
            made = chunking.chunk_index(read.filter("error IS NULL").select(F.col("name").alias("doc_id"), F.col("content").cast("string").alias("content")), size)
            segment = made.select("doc_id", "chunk_ix", F.col("approx_offset").alias("offset"), "text", "tokens", "tfidf", F.lit(version).alias("segment"))
            segment.write.mode("overwrite").parquet(f"{store}/segment-{version}")
            valid = valid.select("name", "length", "modified", "sha256", "error", "segment").union(read.select("name", "length", "modified", "sha256", "error", F.lit(version)))
        valid.write.mode("overwrite").parquet(f"{store}/manifest-{version}")
        if todo:
            delete(spark, contents)
        _tidy(spark, store, version, most_segments)
    counts = manifest(spark, store).agg(F.count_if(F.col("error").isNull()).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    return Refreshed(counts["files"], todo, gone, counts["failed"])


def chunks_of(spark: SparkSession, root: str, store: str, size: int = 2000) -> DataFrame:
    """``kept_chunks`` of a folder's index."""
    return kept_chunks(spark, f"{store.rstrip('/')}/{hashlib.sha256(f'{root.rstrip("/")}:{size}'.encode()).hexdigest()[:16]}")


def _tidy(spark: SparkSession, store: str, version: int, most_segments: int) -> None:
    """One segment instead of too many, and nothing on disk that no manifest names."""
    used = {r.segment for r in manifest(spark, store).select("segment").distinct().collect()}
    if len(used) > most_segments:
        kept_chunks(spark, store).withColumn("segment", F.lit(version + 1)).write.mode("overwrite").parquet(f"{store}/segment-{version + 1}")
        manifest(spark, store).withColumn("segment", F.lit(version + 1)).write.mode("overwrite").parquet(f"{store}/manifest-{version + 1}")
        used, version = {version + 1}, version + 1
    fs, top = file_system(spark, store)
    for f in fs.listStatus(top):
        kind, _, k = f.getPath().getName().partition("-")
        if (kind == "manifest" and int(k) < version) or (kind == "segment" and int(k) not in used):
            fs.delete(f.getPath(), True)


def _embedded(embed: Callable[[list[str]], list[list[float] | None]], dimension: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = embed(list(batch["content"]))
            fit = [None if v is None or (dimension and len(v) != dimension) else [float(x) for x in v] for v in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "embedding": pd.Series(fit, dtype=object, index=batch.index)})

    return run


def kept_vectors(docs: DataFrame, store: str, root: str, embed: Callable[[list[str]], list[list[float] | None]], dimension: int | None = None) -> DataFrame:
    """doc_id, embedding of docs (doc_id, content), kept in the store under ``root`` and embedded again where the content has changed.

    Each root has an index of its own. Documents without a vector, or with one of another dimension, aren't in it. An
    index without vectors isn't kept, so the next call tries again; a failing ``embed`` fails the call and leaves the
    index as it was. Repeated doc_ids must have equal contents.
    """
    spark = docs.sparkSession
    place = f"{store.rstrip('/')}/{hashlib.sha256(root.rstrip('/').encode()).hexdigest()[:16]}"
    done = versions(spark, place, "vectors")
    last = spark.read.schema(VECTORS).parquet(f"{place}/vectors-{done[-1]}") if done else spark.createDataFrame([], VECTORS)
    now = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["doc_id"]).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    known: list[Column] = [now["doc_id"] == last["doc_id"], now["digest"] == last["digest"]]
    missing = now.join(last, known, "left_anti")
    stale = last.join(now, known, "left_anti")
    if not missing.isEmpty() or not stale.isEmpty():
        version = done[-1] + 1 if done else 0
        fresh = missing.select("doc_id", "digest", "content").mapInPandas(_embedded(embed, dimension), VECTORS)
        last.join(now, known, "left_semi").select("doc_id", "digest", "embedding").union(fresh).write.mode("overwrite").parquet(f"{place}/vectors-{version}")
        last = spark.read.schema(VECTORS).parquet(f"{place}/vectors-{version}")
        if last.filter("embedding IS NOT NULL").isEmpty():
            delete(spark, place)
            return spark.createDataFrame([], VECTORS).drop("digest")
        for k in done:
            delete(spark, f"{place}/vectors-{k}")
    return last.filter("embedding IS NOT NULL").drop("digest")
