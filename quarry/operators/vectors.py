"""Cosine similarity of embeddings, and joins of hits with documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the query vectors that a pass takes, and cells of a table of vectors by queries.
BLOCK_NUMBERS, CELLS = 2_000_000, 4_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for different lengths, a zero norm, or null."""
    x, y = (F.transform(v, lambda e: e.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    size = norm(x) * norm(y)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot / size), F.lit(0.0))


def top_similar(vectors: DataFrame, query: list[float], top_n: int = 5, key: str = "vec_id") -> DataFrame:
    """The ``top_n`` rows most like the query vector, with sim above 0, best first, ties by key."""
    target = F.array(*(F.lit(float(v)) for v in query))
    return vectors.withColumn("sim", cosine(F.col("embedding"), target)).filter(F.col("sim") > 0).orderBy(F.desc("sim"), key).limit(top_n)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of norm 1 in double precision; zero rows, and rows that hold what isn't finite, are zero."""
    rows = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(lists: list) -> np.ndarray:
    """Vectors of one length as rows; a null component counts as not a number."""
    return np.array([[np.nan if x is None else x for x in v] for v in lists], np.float64)


def _by_length(vectors) -> dict[int, list[int]]:
    found: dict[int, list[int]] = defaultdict(list)
    for k, v in enumerate(vectors):
        if v is not None and len(v):
            found[len(v)].append(k)
    return found


def _nearest(asked: list[list[float]], top_n: int, key: str):
    """Batches of vectors to each query's best ``top_n`` of the task: _query, key, sim."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = {n: (np.array(at), _unit(_matrix([asked[k] for k in at]))) for n, at in _by_length(asked).items()}
        best = None
        step = max(1, CELLS // max(1, len(asked)))
        for batch in batches:
            for begin in range(0, len(batch), step):
                part = batch[begin : begin + step].sort_values(key, ignore_index=True)
                for n, rows in _by_length(part["embedding"]).items():
                    if n not in queries:
                        continue
                    at, targets = queries[n]
                    sims = _unit(_matrix([part["embedding"][k] for k in rows])) @ targets.T
                    most = min(top_n, len(rows))
                    lowest = np.partition(sims, len(rows) - most, axis=0)[len(rows) - most]
                    i, j = np.nonzero((sims >= lowest) & (sims > 0))  # ties at the end stay, to be settled by key
                    found = pd.DataFrame({"_query": at[j], key: part[key].to_numpy()[np.array(rows)[i]], "sim": sims[i, j]})
                    best = found if best is None else pd.concat([best, found])
                    best = best.sort_values(["_query", "sim", key], ascending=[True, False, True]).groupby("_query", sort=False).head(top_n)
        if best is not None:
            yield best

    return run


def top_similar_many(vectors: DataFrame, queries: DataFrame, keys: list[str], top_n: int = 5, key: str = "vec_id") -> DataFrame:
    """keys, place (from 1), key, sim: for each query (keys, embedding) the ``top_n`` vectors most like it, with sim above 0.

    As ``top_similar`` for each query. Query vectors come to the driver in blocks of ``BLOCK_NUMBERS`` numbers; for each
    a task multiplies its vectors with the block and keeps its best, so a few rows a query and task are exchanged. Null,
    zero and non-finite vectors are like nothing; vectors of another length than the query's neither.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*keys).schema)
    rows_of = vectors.select(key, "embedding")
    made: list[DataFrame] = []

    def passed(rows: list) -> None:
        found = rows_of.mapInPandas(_nearest([list(r["embedding"] or []) for r in rows], top_n, key), f"_query int, `{key}` {kind}, sim double")
        placed = found.withColumn("place", F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("sim"), key))).filter(F.col("place") <= top_n)
        numbered = spark.createDataFrame([(k, *(r[c] for c in keys)) for k, r in enumerate(rows)], f"_query int, {named}")
        made.append(placed.join(F.broadcast(numbered), "_query").select(*keys, "place", key, "sim"))  # a row a query of the block

    held, numbers = [], 0
    for row in queries.select(*keys, "embedding").toLocalIterator():
        size = len(row["embedding"] or []) + 1
        if held and numbers + size > BLOCK_NUMBERS:
            passed(held)
            held, numbers = [], 0
        held.append(row)
        numbers += size
    if held or not made:
        passed(held)
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def hits_to_documents(hits: DataFrame, docs: DataFrame, order: str = "similarity") -> DataFrame:
    """Documents of hits (doc_id, sim), by falling similarity or by path."""
    joined = docs.join(hits.select("doc_id", "sim"), "doc_id")  # broadcast if its size allows
    return joined.orderBy(F.desc("sim"), "doc_id") if order == "similarity" else joined.orderBy(F.split("path", "/"))
