"""Folders listed and files read by tasks, each file's fault kept apart from the others."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

#: Bytes of files that a batch holds, beyond which it is given on.
BATCH_BYTES = 32 << 20
Opener = Callable[[str], BinaryIO]


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """File system of a root, and the root in it."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


def readable(root: str) -> bool:
    """Tasks can open files below such a root."""
    try:
        opened(root)
    except Exception:  # noqa: BLE001  a scheme without a driver here
        return False
    return True


def _children(root: str):
    """Folders (relative names) to what lies directly in them; a folder that can't be listed has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = opened(root)
        for batch in batches:
            for folder in batch["folder"]:
                rows, lead = [], f"{folder}/" if folder else ""
                try:
                    for f in fs.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/") or "/")):
                        if f.type in (pafs.FileType.File, pafs.FileType.Directory):
                            rows.append((lead + f.base_name, f.size, f.mtime_ns // 1000 if f.mtime_ns else 0, f.type == pafs.FileType.Directory, None))
                except OSError as failed:
                    rows = [(folder, 0, 0, True, f"{type(failed).__name__}: {failed}")]
                frame = pd.DataFrame(rows, columns=["name", "length", "micros", "is_folder", "error"])
                yield frame.astype({"length": "float64"}).fillna({"length": 0}).astype({"length": "int64", "micros": "int64"})

    return run


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """name (relative), length, modified, error of the files below a root, hidden and empty ones too, and of folders that can't be listed.

    A level of folders is a job whose tasks list a folder each, so the driver sees no file. No rows if the root is missing.
    """
    fs, top = opened(root)
    kinds = "name string, length long, micros long, is_folder boolean, error string"
    found = spark.createDataFrame([], kinds)
    if fs.get_file_info(top).type == pafs.FileType.Directory:
        folders = spark.createDataFrame([("",)], "folder string")
        place, level = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}", 0
        while True:
            folders.mapInPandas(_children(root), kinds).write.parquet(f"{place}/{level}")
            made = spark.read.schema(kinds).parquet(f"{place}/{level}")
            found = found.union(made.filter("NOT is_folder OR error IS NOT NULL"))
            folders = made.filter("is_folder AND error IS NULL").select(F.col("name").alias("folder"))
            if not recursive or folders.isEmpty():
                break
            folders, level = folders.repartition(spark.sparkContext.defaultParallelism), level + 1
    return found.select("name", "length", F.timestamp_micros("micros").alias("modified"), "error")


def _each(root: str, whole: bool, opener: Opener | None):
    """Files to their digests, and contents if asked, or to their errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = opened(root)
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                digest, parts, fault = hashlib.sha256(), [], row.error
                if fault is None:
                    try:
                        with (opener or fs.open_input_stream)(f"{top.rstrip('/')}/{row.name}") as stream:
                            while data := stream.read(1 << 20):
                                digest.update(data)
                                if whole:
                                    parts.append(data)
                    except OSError as failed:
                        fault, parts = f"{type(failed).__name__}: {failed}", []
                rows.append((row.name, row.length, row.modified, None if fault else digest.hexdigest(), b"".join(parts) if whole and not fault else None, fault))
                held += sum(map(len, parts))
                if held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["name", "length", "modified", "sha256", "content", "error"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["name", "length", "modified", "sha256", "content", "error"])

    return run


def read_each(files: DataFrame, root: str, whole: bool = False, opener: Opener | None = None) -> DataFrame:
    """``files`` (name, length, modified, error) with sha256, content (if ``whole``) and error of the files that can't be read.

    The files are dealt to tasks, and a file is read in pieces; without ``whole`` no task holds more than a piece.
    """
    dealt = files.select("name", "length", "modified", "error").repartition(files.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInPandas(_each(root, whole, opener), "name string, length long, modified timestamp, sha256 string, content binary, error string")
