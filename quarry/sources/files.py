"""Files as documents: scans, catalogues, uploads, chunk sidecars."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from . import scan
from .shared import file_system

MOST_UPLOAD = 20 << 20
SIDECAR = ".chunks.jsonl"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name (relative), length, modified of all files below a root, empty and hidden ones too; no rows if it is missing."""
    jvm, context = spark._jvm, spark.sparkContext
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(context._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(top):
        base = fs.makeQualified(top).toString().rstrip("/")
        found = fs.listFiles(top, True)
        while found.hasNext():
            f = found.next()
            path = f.getPath().toString()
            rows.append((path, path[len(base) + 1 :], f.getLen(), f.getModificationTime()))
    listed = spark.createDataFrame(rows, "path string, name string, length long, millis long")
    return listed.select("path", "name", "length", F.timestamp_millis("millis").alias("modified"))


def root_directories(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders directly below a root, empty ones too, sorted."""
    fs, top = file_system(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(top) if f.isDirectory()] if fs.exists(top) else []
    return spark.createDataFrame([(n,) for n in names], "name string").orderBy("name")


def read_documents(spark: SparkSession, root: str, most_lines: int = 50, most_chars: int = 1 << 20) -> DataFrame:
    """doc_id (the path), path, display_name, content of the text and Markdown files below a root, whatever their suffixes' case."""
    fs, top = file_system(spark, root)
    if not fs.exists(top) or not fs.listFiles(top, True).hasNext():
        return spark.createDataFrame([], "doc_id string, path string, display_name string, content string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").load(root)
    base = F.element_at(F.split("path", "/"), -1)
    usable = raw.select("path", base.alias("base"), F.col("content").cast("string").alias("content")).filter(~F.contains("base", F.lit("?")) & T.extension(F.col("base")).isin(".txt", ".md"))
    kept = usable.filter(F.length("content").between(1, most_chars))
    return kept.select(F.col("path").alias("doc_id"), "path", T.display_name(F.col("base")).alias("display_name"), T.truncate_lines(F.col("content"), most_lines).alias("content"))


def path_order(path: str = "path") -> Column:
    """Order of paths by their components."""
    return F.split(path, "/")


def catalogue(spark: SparkSession, root: str, subfolder: str | None = None, recursive: bool = True, opener: scan.Opener | None = None) -> DataFrame:
    """name, filename, size, modified (ISO, UTC), sha256 (16 digits, or ``unreadable``) of every file but sidecars, by name.

    With a subfolder names are relative to it; without ``recursive`` only what lies directly there counts. A missing
    root or subfolder has no rows, a subfolder that leaves the root is an error. One unreadable file doesn't hide others.
    """
    if subfolder and (subfolder.startswith("/") or ".." in subfolder.replace("\\", "/").split("/")):
        raise ValueError("a subfolder may not leave the root")
    top = f"{root.rstrip('/')}/{subfolder.strip('/')}" if subfolder else root
    if scan.readable(top):
        found = scan.read_each(_counted(scan.listed(spark, top, recursive)).filter("error IS NULL"), top, opener=opener)
        rows = found.select("name", "length", "modified", F.col("sha256").alias("sha"))
    else:  # a store that only Spark's readers open
        listed = _counted(list_files(spark, top))
        listed = listed if recursive else listed.filter(~F.contains("name", F.lit("/")))
        some = not listed.isEmpty()
        raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreCorruptFiles=True, ignoreMissingFiles=True).load(top) if some else spark.createDataFrame([], "path string, content binary")
        sha = F.coalesce("sha", F.when(F.col("length") == 0, F.sha2(F.lit(b""), 256)))
        rows = listed.join(raw.select("path", F.sha2("content", 256).alias("sha")), "path", "left").select("name", "length", "modified", sha.alias("sha"))
    modified = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("modified")
    return rows.select("name", F.element_at(F.split("name", "/"), -1).alias("filename"), F.col("length").alias("size"), modified, F.substring(F.coalesce("sha", F.lit("unreadable")), 1, 16).alias("sha256")).orderBy("name")


def _counted(files: DataFrame) -> DataFrame:
    """Files of a listing (name) that count: no sidecars, no names with a question mark."""
    return files.filter(~F.contains(F.element_at(F.split("name", "/"), -1), F.lit("?")) & ~F.endswith("name", F.lit(SIDECAR)))


def largest(files: DataFrame, top_n: int = 5) -> DataFrame:
    """The largest files (name, size) without dot files and sidecars, with megabytes of two decimals; ties by name."""
    shown = files.filter(~F.startswith(F.element_at(F.split("name", "/"), -1), F.lit(".")) & ~F.endswith("name", F.lit(SIDECAR)))
    return shown.orderBy(F.desc("size"), "name").limit(top_n).withColumn("mb", F.format_string("%.2f", F.bround(F.col("size") / (1 << 20), 2)))


def listing_page(files: DataFrame, most: int = 30) -> DataFrame:
    """The first rows by name, each with the number of those not shown."""
    total = files.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return files.orderBy("name").limit(most).crossJoin(F.broadcast(total))  # one row


def validated_uploads(uploads: DataFrame, most: int = MOST_UPLOAD, allowed: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """uploads (filename, content, subfolder) with target, size, sha256 and error (null if accepted).

    The first upload of a target, by digest, keeps it unless a ``stored`` file (name) has it; the others get eight digits of
    the content's digest, and equal contents a number more. Subfolders may not leave the root. ``allowed`` extensions are
    enforced only if given.
    """
    size, sha = F.octet_length("content"), F.sha2("content", 256)
    kind = T.inferred_extension(F.col("filename"))
    name = T.sanitized_name(F.regexp_replace(F.coalesce("filename", F.lit("attachment")), r"\.[^.]*$", ""))
    folder = F.coalesce("subfolder", F.lit(""))
    error = F.when(size > most, "too large").when(F.startswith(folder, F.lit("/")) | F.array_contains(F.split(folder, r"[/\\]"), ".."), "bad subfolder")
    if allowed is not None:
        error = error.when(~kind.isin(allowed), "type not allowed")
    lead = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name)
    rows = uploads.withColumns({"size": size.cast("long"), "sha256": sha, "_lead": lead, "_kind": kind, "error": error})
    rows = rows.withColumn("_open", F.col("error").isNull())
    of_target = Window.partitionBy("_open", "_lead", "_kind").orderBy("sha256")
    of_content = Window.partitionBy("_open", "_lead", "_kind", "sha256").orderBy("sha256")
    rows = rows.withColumns({"_nth": F.row_number().over(of_target), "_same": F.row_number().over(of_content)})
    taken = F.lit(False)
    if stored is not None:
        rows = rows.join(stored.select(F.col("name").alias("_stored")).distinct(), F.concat("_lead", "_kind") == F.col("_stored"), "left")
        taken = F.col("_stored").isNotNull()
    more = F.when(F.col("_same") > 1, F.concat(F.lit("_"), F.col("_same").cast("string"))).otherwise("")
    suffix = F.when((F.col("_nth") > 1) | taken, F.concat(F.lit("_"), F.substring("sha256", 1, 8), more)).otherwise("")
    return rows.withColumn("target", F.when(F.col("_open"), F.concat("_lead", suffix, "_kind"))).drop("_lead", "_kind", "_open", "_nth", "_same", "_stored")


def store_uploads(uploads: DataFrame, root: str) -> DataFrame:
    """Write the accepted rows of ``validated_uploads`` below a root that all executors share; name, size, sha256 (16 digits).

    A file is written aside and then moved, so a task that runs again does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for target, content in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                path = f"{top}/{target}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                aside = f"{path}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(aside) as out:
                    out.write(content)
                fs.move(aside, path)
            yield batch.select([0, 1, 2])

    rows = uploads.filter(F.col("error").isNull()).select(F.col("target").alias("name"), "size", F.substring("sha256", 1, 16).alias("sha256"), F.coalesce("content", F.lit(b"")).alias("content"))
    return rows.mapInArrow(write, "name string, size long, sha256 string")


def write_chunks(docs: DataFrame, path: str, size: int = 2000, buckets: int = 16) -> int:
    """Write the chunk index of docs (doc_id, content) as JSON in ``buckets`` folders by the hash of doc_id; the number of documents.

    Documents without a chunk count too. A null content has none.
    """
    rows = chunking.chunk_index(docs, size).select("doc_id", "chunk_ix", F.col("approx_offset").alias("offset"), "tokens", "tfidf")
    rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path)
    return docs.select("doc_id").distinct().count()


def reindex(spark: SparkSession, root: str, path: str, size: int = 2000) -> int:
    """Write the chunk index of all files below a root, sidecars apart; the number of files, without those that can't be read.

    An empty file counts and has no chunks.
    """
    fs, top = file_system(spark, root)
    if not fs.exists(top) or not fs.listFiles(top, True).hasNext():
        return 0
    raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreCorruptFiles=True, ignoreMissingFiles=True).load(root)
    base = F.element_at(F.split("path", "/"), -1)
    usable = raw.filter(~F.contains(base, F.lit("?")) & ~F.endswith(base, F.lit(SIDECAR)))
    empty = list_files(spark, root).filter((F.col("length") == 0) & ~F.contains("name", F.lit("?")) & ~F.endswith("name", F.lit(SIDECAR))).count()
    return empty + write_chunks(usable.select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("content")), path, size)


def fetched_text(pages: DataFrame, column: str = "html", most: int | None = 32_000) -> DataFrame:
    """Pages with file_name and fetched: the whole body or its first characters. The caller supplies the bodies."""
    body = F.col(column) if most is None else F.substring(column, 1, most)
    return pages.withColumns({"file_name": T.url_file_name(F.col("url")), "fetched": body})
