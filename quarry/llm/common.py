"""Shared helpers of the corpus operators: shared-folder tables, text columns, safe names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task may take whatever their keys.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is absent and the master is local (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors and lets a result be used twice without recomputing it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete shared tables whose last reader is done."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` (a shared table) joined with ``table`` (one row a key), the keys that hold many rows dealt over several tasks.

    A key is hot with over a quarter of a task's mean share of the rows, so there are at most four hot keys a task; they
    are broadcast. Rows of a hot key are dealt by the hash of ``spread``, and its row of the table is copied as often.
    Up to ``FEW`` rows in all are joined as they are.
    """
    n, most = rows.count(), 4 * partitions_for(rows)
    if n <= FEW:
        return rows.join(table, key, how)
    least = max(1, n // most)
    hot = rows.groupBy(key).count().filter(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_copies"))
    hot = F.broadcast(shared_table(hot, "hot"))
    one = F.coalesce("_copies", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_copies")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_copies")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key's text modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def partitions_for(df: DataFrame) -> int:
    """Shuffle width that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def fewer_collections() -> None:
    """In a Python worker that makes many small objects without cycles: let the cycle collector run less often."""
    gc.set_threshold(100_000, 50, 100)


_worker: dict[str, Any] = {}


def worker_cache(owner: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task for ``owner``.

    Workers are used again by later stages, so what other owners kept is given back, to the system too, when another asks.
    """
    if owner not in _worker:
        if _worker:
            _worker.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)
        _worker[owner] = make()
    return _worker[owner]


class Cache:
    """A dictionary (``held``) of about ``budget`` bytes at most: it is emptied when more comes than there is room for."""

    def __init__(self, budget: int = 40 << 20):
        self.held: dict = {}
        self.budget, self.used = budget, 0

    def make_room(self, entries: int, content: int) -> bool:
        """Room for ``entries`` with ``content`` bytes of keys and values; True if all that was there had to go."""
        size = content + 180 * entries  # what an entry takes besides its bytes
        full = self.used + size > self.budget
        if full:
            self.held.clear()
            self.used = 0
        self.used += size
        return full


def kept_columns(docs: DataFrame, keep: list[str] | None, made: list[str]) -> list[str]:
    """Columns to carry through an operator: ``keep`` or all, without those that it makes (names compare without case)."""
    taken = {m.lower() for m in made}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]


def schema_of(docs: DataFrame, columns: list[str], more: str) -> str:
    """DDL of some of a table's columns and ``more``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), more])
