"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until splitters fit, then one exchange.

Rows are ordered by the hash of their text, so that equal texts lie together, then by doc_id, then by their place in a
table. Splitters fall between texts where that stays within the tolerance, inside a group of equal texts otherwise, and
inside a group of repeated rows (or of null ids) if need be. Null texts count as empty with one byte. Empty input gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, utf8

KEY_MIN, KEY_MAX = -(1 << 63), (1 << 63) - 1
#: Rows of a table of hot texts that may be broadcast.
MOST_HOT = 100_000


def size_of(column: str = "text") -> Column:
    """UTF-8 bytes plus one; null counts as none."""
    return (F.octet_length(utf8(column)) + F.lit(1)).cast("long")


def bytes_below(rows: DataFrame, probes: np.ndarray, column: str) -> np.ndarray:
    """Exact bytes of the rows whose ``column`` lies below each probe; the counts are summed in every partition first."""
    edges = np.sort(probes)

    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(np.int64), "right").astype(np.int32))

    got = {r["cell"]: r["n"] for r in rows.groupBy(cell(F.col(column)).alias("cell")).agg(F.sum("size").alias("n")).collect()}
    sums = np.cumsum([got.get(k, 0) for k in range(len(edges))])
    return sums[np.searchsorted(edges, probes)]


def refine(rows: DataFrame, column: str, targets: list[int], low: int, high: int, slack: int, width: int) -> list[tuple[int, int, int]]:
    """For each target: (boundary, bytes below it, bytes below the next value), probing ``width`` keys a round.

    Ends for a target when some boundary is within ``slack`` of it, or no key is left between its two neighbours.
    """
    a = [(low, 0)] * len(targets)
    b = [(high, None)] * len(targets)
    done: list[tuple[int, int, int] | None] = [None] * len(targets)
    while open_ := [i for i, x in enumerate(done) if x is None]:
        asked = []
        for i in open_:
            lo, hi = a[i][0], b[i][0]
            n = min(width, hi - lo - 1)
            asked.append([lo + (hi - lo) * (k + 1) // (n + 1) for k in range(n)] if n > 0 else [])
        flat = np.array(sorted({x for xs in asked for x in xs} | {b[i][0] for i in open_ if b[i][1] is None}), np.int64)
        sums = dict(zip(flat.tolist(), bytes_below(rows, flat, column).tolist(), strict=True)) if len(flat) else {}
        for i, xs in zip(open_, asked, strict=True):
            if b[i][1] is None:
                b[i] = (b[i][0], sums[b[i][0]])
            for x in xs:
                if sums[x] <= targets[i] and x > a[i][0]:
                    a[i] = (x, sums[x])
                if sums[x] > targets[i] and x < b[i][0]:
                    b[i] = (x, sums[x])
            near = min((a[i], b[i]), key=lambda p: abs(p[1] - targets[i]))
            if abs(near[1] - targets[i]) <= slack or b[i][0] - a[i][0] <= 1:
                done[i] = (near[0], near[1], 0) if abs(near[1] - targets[i]) <= slack else (a[i][0], a[i][1], b[i][1])
    return done


def splitters(rows: DataFrame, cells: int, tolerance: float, width: int = 48) -> list[tuple[int, int, int]]:
    """(key, doc_id, place) below which each cell but the last ends. ``rows``: key, doc, place, size."""
    found = rows.agg(F.sum("size").alias("n"), *(f(c).alias(f"{c}{k}") for c in ("doc", "place") for k, f in enumerate((F.min, F.max)))).first()
    total = found["n"] or 0
    if not total or cells < 2:
        return []
    out = [(KEY_MIN, KEY_MIN, KEY_MIN)] * (cells - 1)

    slack = int(total / cells * tolerance)

    def split(group: DataFrame, columns: list[str], before: tuple[int, ...], wanted: list[tuple[int, int]]) -> None:
        """Boundaries of (cell, bytes below it in the group) by the first column, inside its groups by the next."""
        column, inside = columns[0], {}
        low, high = (KEY_MIN, KEY_MAX) if column == "key" else (found[f"{column}0"], found[f"{column}1"] + 1)
        for (i, target), (value, below, above) in zip(wanted, refine(group, column, [w for _, w in wanted], low, high, slack, width), strict=True):
            out[i] = (*before, value, KEY_MIN, KEY_MIN)[:3]
            if above and len(columns) > 1:  # rows equal in this column span the target
                inside.setdefault(value, []).append((i, target - below))
        for value, more in inside.items():
            split(group.filter(F.col(column) == value), columns[1:], (*before, value), more)

    split(rows, ["key", "doc", "place"], (), [(k, total * (k + 1) // cells) for k in range(cells - 1)])
    return sorted(out)


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, cell_bytes: int = 128 << 20) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to ``shards`` - 1, near equal bytes) and ``slot`` (gapless from 0 in a shard).

    Only the splitters of the shards are searched. For the one exchange a shard is cut into cells of about ``cell_bytes``:
    equal ranges of the hash, and parts of a text whose copies alone fill more than a cell. What a cell's slots start
    from comes from a small table of the cells' counts, so tasks stay bounded and the driver holds no row a cell.
    Existing columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    key, doc = F.xxhash64(utf8()), F.coalesce(F.col("doc_id").cast("long"), F.lit(KEY_MIN + 1))
    # Places are those of the rows in this table's files, whatever order the input would come in if read again.
    held = shared_table(docs.withColumns({"_key": key, "_doc": doc, "_size": size_of()}), "shard-rows")
    held = held.withColumn("_place", F.monotonically_increasing_id())
    total = held.agg(F.sum("_size")).first()[0] or 0
    ends = splitters(held.select("_key", "_doc", "_place", "_size").toDF("key", "doc", "place", "size"), shards, tolerance)
    edges = np.array(ends, np.int64).reshape(-1, 3)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, doc: pd.Series, place: pd.Series) -> pd.Series:
        row = [c.to_numpy(np.int64) for c in (key, doc, place)]
        at = np.searchsorted(edges[:, 0], row[0], "left").astype(np.int32)
        for j in np.unique(edges[:, 0]):  # shards - 1 at most
            here = np.flatnonzero(row[0] == j)
            if len(here):
                for _, d, p in edges[edges[:, 0] == j]:
                    at[here] += (row[1][here] > d) | ((row[1][here] == d) & (row[2][here] >= p))
        return pd.Series(at)

    ranges = max(1, -(-total // cell_bytes))
    hot = held.groupBy("_key").agg(F.sum("_size").alias("n")).filter(F.col("n") > cell_bytes)
    hot = shared_table(hot.select("_key", F.ceil(F.col("n") / cell_bytes).cast("int").alias("_parts")), "hot")
    hot = F.broadcast(hot) if ranges <= MOST_HOT else hot  # fewer rows than ranges

    def placed(rows: DataFrame) -> DataFrame:
        at = F.least(F.floor((F.col("_key") / F.lit(float(1 << 64)) + 0.5) * ranges), F.lit(ranges - 1)).cast("int")
        part = F.pmod(F.xxhash64("_doc", "_place"), F.coalesce("_parts", F.lit(1))).cast("int")
        return rows.withColumns({"_shard": shard_of("_key", "_doc", "_place"), "_range": at}).join(hot, "_key", "left").withColumn("_part", part).drop("_parts")

    cell = ["_shard", "_range", "_part"]
    before = Window.partitionBy("_shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed(held.select("_key", "_doc", "_place")).groupBy(*cell).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    starts = shared_table(starts, "cells")
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("_key", "_doc", "_place"))
    keyed = placed(held).withColumn("_nth", nth)
    out = keyed.join(starts, cell).withColumns({"slot": F.col("_start") + F.col("_nth") - 1, "shard": F.col("_shard")})
    return out.drop("_key", "_doc", "_place", "_size", "_nth", "_start", *cell)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the shard and slot of every document under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", size_of().alias("size"), F.crc32(utf8()).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
