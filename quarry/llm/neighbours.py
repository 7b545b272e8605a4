"""Approximate nearest neighbours by largest inner product: NN-descent graph, greedy graph search.

Equal vectors count as one node with its copies. Nodes lie in blocks of bounded size (``BLOCK_ROWS``), each with a graph
of its own. The graph starts from the neighbours in random-hyperplane leaves; then Spark joins bring the neighbours of each
node together with their vectors, and every neighbour of a neighbour may replace a worse one, until hardly any does. Queries
go to every block in parts of ``QUERY_ROWS``, so a block's index is read once a part, and search its graph greedily from some entry points and the node's own neighbours; the best over all blocks are kept.

Vectors that are null, empty, zero or hold null or non-finite components, rows without an id, and vectors of another
length than most take no part. Rows that repeat an id with the same vector count once; with other vectors, each counts.
Extra columns are ignored. Without candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hot_join, shared_table

BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192
NEAR, JOINED, TREES, LEAF = 28, 14, 3, 160
#: The graph is settled when a round finds new edges for less than this share of all.
SETTLED = 0.02
POOL, STEP, ENTRIES = 200, 8, 48


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), of the rows that take part."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    good = good.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad).filter(F.exists(v, lambda x: x != 0))
    size = good.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()  # one row
    return good.filter(F.size(v) == (size[0]["size"] if size else 0))


def matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.empty((0, 0), kind)


def leaf_edges(nodes: DataFrame, width: int, near: int, rows: float) -> DataFrame:
    """block, u, v, sim: the nearest nodes of each node in its leaf of each of some random-hyperplane trees.

    ``rows``: nodes of a block on average, of which leaves hold about ``LEAF``.
    """
    bits = int(np.ceil(np.log2(max(1.0, rows / LEAF))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(3).normal(size=(width, TREES * bits)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            side = (matrix(batch.column(2)) @ planes > 0).reshape(batch.num_rows, TREES, bits)
            codes = (side * (1 << np.arange(bits))).sum(2)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(codes[:, t], pa.int32())], ["block", "node", "vector", "tree", "leaf"])

    def within(table: pa.Table) -> pa.Table:
        ids, block = table.column("node").to_numpy(), table.column("block")[0].as_py()
        x = matrix(table.column("vector"))
        order = np.random.default_rng(1).permutation(len(ids))
        us, vs, sims = [], [], []
        for at in range(0, len(ids), 4 * LEAF):
            own = order[at : at + 4 * LEAF]
            s = x[own] @ x[own].T
            np.fill_diagonal(s, -np.inf)
            k = min(near, len(own) - 1)
            if k < 1:
                continue
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            us.append(np.repeat(ids[own], k))
            vs.append(ids[own][top].ravel())
            sims.append(np.take_along_axis(s, top, 1).ravel())
        u, v, s = (np.concatenate(c) if c else np.empty(0) for c in (us, vs, sims))
        return pa.table({"block": pa.array(np.full(len(u), block), pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(s, pa.float32()), "fresh": pa.array(np.ones(len(u), bool))})

    coded = nodes.select("block", "node", "vector").mapInArrow(code, "block int, node long, vector array<float>, tree int, leaf int")
    return coded.groupBy("block", "tree", "leaf").applyInArrow(lambda t: within(t), "block int, u long, v long, sim float, fresh boolean")


def best_edges(edges: DataFrame, near: int) -> DataFrame:
    """The ``near`` best different edges of each node; an edge that was there before isn't fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in [*batches, None]:
            if batch is not None:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([carried, table]) if carried is not None else table
            elif carried is None:
                return
            else:
                table = carried
            u = table.column("u").to_numpy()
            if not len(u):
                continue
            cut = len(u) if batch is None else int(np.searchsorted(u, u[-1]))
            carried = table.slice(cut)
            part = table.slice(0, cut)
            u, v, s, f = (part.column(c).to_numpy() for c in ("u", "v", "sim", "fresh"))
            order = np.lexsort((f, v, -s, u))
            u, v, s, f = u[order], v[order], s[order], f[order]
            # equal edges have equal sims and lie together
            new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, bool)
            order, u, v, s, f = order[new], u[new], v[new], s[new], f[new]
            rank = np.arange(len(u)) - np.searchsorted(u, u)
            kept = rank < near
            yield pa.RecordBatch.from_arrays([part.column("block").combine_chunks().take(pa.array(order[kept])), pa.array(u[kept]), pa.array(v[kept]), pa.array(s[kept]), pa.array(f[kept])], ["block", "u", "v", "sim", "fresh"])

    return edges.repartition("u").sortWithinPartitions("u").mapInArrow(run, "block int, u long, v long, sim float, fresh boolean")


def descend(edges: DataFrame, nodes: DataFrame, near: int, joined: int) -> DataFrame:
    """One round of NN-descent: the neighbours of each node, out and in, meet and may become each other's neighbours.

    Two that met before, by edges that aren't fresh, don't meet again.
    """
    out = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    into = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    ranked = edges.withColumn("out", out).withColumn("into", into)
    around = ranked.filter(F.col("out") <= joined).select(F.col("u").alias("centre"), F.col("v").alias("node"), "fresh")
    around = around.union(ranked.filter(F.col("into") <= joined).select(F.col("v").alias("centre"), F.col("u").alias("node"), "fresh"))
    around = around.groupBy("centre", "node").agg(F.min("fresh").alias("fresh"))
    worst = edges.groupBy("u").agg(F.min("sim").alias("worst")).withColumnRenamed("u", "node")
    carried = nodes.join(worst, "node", "left").select("node", "block", "vector", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"))
    met = around.join(carried, "node").select("centre", "block", "node", "worst", "vector", "fresh").repartition("centre").sortWithinPartitions("centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            centre, node, worst, block, fresh = (table.column(c).to_numpy() for c in ("centre", "node", "worst", "block", "fresh"))
            x = matrix(table.column("vector"))
            starts = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
            sizes = np.diff(np.append(starts, len(centre)))
            us, vs, sims, blocks = [], [], [], []
            for size in np.unique(sizes):
                if size < 2:
                    continue
                rows = starts[sizes == size][:, None] + np.arange(size)
                for at in range(0, len(rows), 512):
                    r = rows[at : at + 512]
                    s = x[r] @ x[r].transpose(0, 2, 1)
                    s[:, np.arange(size), np.arange(size)] = -np.inf
                    s[s <= worst[r][:, :, None]] = -np.inf
                    s[~(fresh[r][:, :, None] | fresh[r][:, None, :])] = -np.inf
                    g, i, j = np.nonzero(s > -np.inf)
                    us.append(node[r[g, i]])
                    vs.append(node[r[g, j]])
                    sims.append(s[g, i, j])
                    blocks.append(block[r[g, i]])
            u, v, s, b = (np.concatenate(c) if c else np.empty(0) for c in (us, vs, sims, blocks))
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32()), pa.array(np.ones(len(u), bool))], ["block", "u", "v", "sim", "fresh"])

        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([carried, table]) if carried is not None else table
            centre = table.column("centre").to_numpy()
            if not len(centre):
                continue
            cut = int(np.searchsorted(centre, centre[-1]))
            if cut:
                yield pairs(table.slice(0, cut))
            carried = table.slice(cut)
        if carried is not None and len(carried):
            yield pairs(carried)

    known = edges.withColumn("fresh", F.lit(False))
    return best_edges(known.union(met.mapInArrow(run, "block int, u long, v long, sim float, fresh boolean")), near)


def greedy_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, pool: int = POOL, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes found for each query and their products: expand the best unexpanded of a pool until none is left.

    graph: neighbours of each node, -1 for none; starts: entry nodes of each query, -1 for none.
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for no node
    ids, sims = np.full((m, pool), n), np.full((m, pool), -np.inf, np.float32)
    done = np.ones((m, pool), bool)
    near = np.where(starts < 0, n, starts)
    live = np.arange(m)
    while len(live):
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        wide = int((near < n).sum(1).max(initial=0))
        near = np.sort(near, axis=1)[:, :wide]
        seen[live[:, None], near] = True
        seen[:, n] = True
        s = np.matmul(x[np.minimum(near, n - 1)], queries[live][:, :, None])[:, :, 0]
        s[near == n] = -np.inf
        all_s, all_i = np.concatenate([sims[live], s], 1), np.concatenate([ids[live], near], 1)
        all_d = np.concatenate([done[live], near == n], 1)
        if all_s.shape[1] > pool:
            top = np.argpartition(-all_s, pool - 1, axis=1)[:, :pool]
            all_s, all_i, all_d = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_d))
        sims[live], ids[live] = all_s, all_i
        open_s = np.where(all_d, -np.inf, all_s)
        pick = np.argpartition(-open_s, step - 1, axis=1)[:, :step] if pool > step else np.argsort(-open_s, axis=1)
        chosen = np.where(np.isneginf(np.take_along_axis(open_s, pick, 1)), n, np.take_along_axis(all_i, pick, 1))
        np.put_along_axis(all_d, pick, True, 1)
        done[live] = all_d
        go = (chosen < n).any(1)
        live, chosen = live[go], chosen[go]
        near = np.where((chosen < n)[:, :, None], graph[np.minimum(chosen, n - 1)], n).reshape(len(live), chosen.shape[1] * graph.shape[1])
        near[near < 0] = n
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def adjacency(n: int, u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node, out and in, as rows padded by -1; edges come best first."""
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    _, first = np.unique(a * n + b, return_index=True)
    a, b = a[np.sort(first)], b[np.sort(first)]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    kept = rank < most
    out = np.full((n, most), -1, np.int64)
    out[a[kept], rank[kept]] = b[kept]
    return out


def nearest(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of every row for which ``is_query`` (on vec_id) holds."""
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.reverse("vector")).alias("k2")]
    rows = shared_table(usable_vectors(vectors).withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).select("vec_id", "vector", *keys), "vectors")
    counted = rows.select("k1", "k2").distinct().count()
    blocks = max(1, -(-counted // BLOCK_ROWS))
    first = F.min_by("vector", "vec_id").alias("vector")  # of equal vectors, before the exchange
    firsts = rows.groupBy("k1", "k2").agg(first)
    # An id that came with several vectors would name several nodes, so nodes are numbered by their keys.
    nodes = firsts.select(F.col("k1").alias("node"), "vector", F.pmod(F.xxhash64("k1"), F.lit(blocks)).cast("int").alias("block"))
    nodes = shared_table(nodes, "nodes")
    width = len((nodes.select("vector").first() or [[]])[0])
    small = nodes.select("block", "node", F.col("vector").cast("array<float>").alias("vector"))
    edges = shared_table(best_edges(leaf_edges(small, width, NEAR, counted / blocks), NEAR), "edges")
    while True:
        before, edges = edges, shared_table(descend(edges, small, NEAR, JOINED), "edges")
        forget(before)
        found = edges.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).first()
        if found["fresh"] <= SETTLED * found["n"]:  # sims of a node's edges only grow, so this comes
            break
    wanted = rows.filter(is_query).select("vec_id", F.col("k1").alias("node")).distinct()
    asked = shared_table(wanted.select("node").distinct().join(nodes, "node").select("node", "vector"), "queries")
    chunks = max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = edges.groupBy(F.col("u").alias("node")).agg(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False)["v"].alias("near"))  # NEAR at most
    index = nodes.join(lists, "node", "left").withColumn("chunk", every(chunks)).select("block", "chunk", "node", "vector", "near")
    queries = asked.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks)).select("block", "chunk", "node", "vector")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return kinds.empty_table()
        names, x = left.column("node").to_numpy(), matrix(left.column("vector"), np.float64)
        order = np.argsort(names)
        lists = left.column("near").combine_chunks()
        sizes = np.array([len(v) if v is not None else 0 for v in lists.to_pylist()])
        flat = lists.flatten().to_numpy()
        v = order[np.minimum(np.searchsorted(names, flat, sorter=order), len(names) - 1)]
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        u = np.repeat(np.arange(len(names)), sizes)
        by_rank = np.argsort(rank, kind="stable")
        graph = adjacency(len(names), u[by_rank], v[by_rank], NEAR + NEAR // 2)
        asked, q = right.column("node").to_numpy(), matrix(right.column("vector"), np.float64)
        rng = np.random.default_rng(9)
        x32, out = x.astype(np.float32), []
        at_own = order[np.minimum(np.searchsorted(names, asked, sorter=order), len(names) - 1)]
        own = np.where(names[at_own] == asked, at_own, -1)
        for at in range(0, len(asked), 64):
            part = slice(at, at + 64)
            m = len(asked[part])
            starts = np.concatenate([rng.integers(0, len(names), (m, ENTRIES)), own[part][:, None]], 1)
            got, sims = greedy_search(x32, graph, q[part].astype(np.float32), starts)
            kept = got[:, : 2 * top + 2]
            score = np.einsum("mkd,md->mk", x[np.minimum(kept, len(names) - 1)], q[part])
            score[kept == len(names)] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
            score, kept = np.take_along_axis(score, best, 1), np.take_along_axis(kept, best, 1)
            real = score > -np.inf
            out.append((np.repeat(asked[part], real.sum(1)), names[kept[real]], score[real]))
        columns = [np.concatenate([o[k] for o in out]) for k in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    hits = index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(search, "query long, node long, score double")
    hits = shared_table(hits, "hits")
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("k") <= 2 * top + 2)
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    copies = rows.select("k1", "k2", "vec_id").distinct().withColumn("k", copy).filter(F.col("k") <= top + 1).select(F.col("k1").alias("node"), "vec_id")
    # The first top + 1 rows for a query vector serve every query with that vector.
    spread = best.select("query", "node", "score").join(copies, "node")
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    spread = spread.withColumn("k", rank("query")).filter(F.col("k") <= top + 1).select("query", "vec_id", "score")
    lists = spread.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))  # top + 1 at most
    asking = shared_table(wanted.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "asking")
    per = hot_join(asking, lists, "query", "query_id")  # copies of one vector may be many
    per = per.withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top))
    return per.select("query_id", F.posexplode("found").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest found of every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
