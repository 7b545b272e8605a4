"""Merkle manifest of a dataset: leaves in per-group trees, the groups' roots in one tree, a proof for every row.

Nodes are combined by events: a task keeps partial parents, takes indexed digests of children, and as soon as a parent
has as many as the size of its tree says, its own digest is the next event. Parents whose children lie in several
tasks are a frontier that is dealt anew by ancestor until none is left. Links from parents back to children give the
siblings of every leaf.

A null field has a code of its own, so a null text differs from an empty one. A null group is a group, the first; a null
doc_id comes first in its group. Rows equal in group and doc_id are ordered by their leaf, and repeated rows are leaves
each. An empty table has no rows and no root. Extra columns, whatever their names, aren't carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions_for, shared_table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels of a tree that one task may resolve when a frontier is dealt anew, and partial parents that a task keeps.
LEVELS, MOST_OPEN = 3, 100_000
EVENTS = "tree string, n long, level int, parent long, at array<int>, children array<string>, digest string, is_root boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row: each field as its byte count, a colon and its text, or a dash if null."""

    def code(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest_of(F.concat(*map(code, fields.values())))


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a shared table with a column tree) with ``idx``, the place in its tree, and ``n``, the tree's rows.

    One exchange by ranges of (tree, order) with the row's place in the table as the last key, so that no tree and no set
    of repeated rows lies in one task; then a table with a row for each range and tree says where places start. The
    second result is the table to forget after the last use.
    """
    keys = ["tree", *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys)
    table = shared_table(dealt.drop("_row").withColumn("_pos", F.monotonically_increasing_id()), "merkle-order")
    cell = F.shiftright("_pos", 33).cast("int").alias("_range")
    counts = table.groupBy(cell, "tree").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    placed = table.withColumn("_range", cell).join(starts, ["_range", "tree"])
    return placed.withColumn("idx", F.col("_pos") + F.col("_shift")).drop("_range", "_pos", "_shift"), table


def _cascade(arity: int):
    """Partial parents (rows of EVENTS without digest) to finished nodes and the partial parents that remain."""

    def nodes_at(n: int, level: int) -> int:
        return -(-n // arity**level)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, dict[int, str]] = {}
        out: list[tuple] = []

        def merge(tree: str, n: int, level: int, parent: int, at, digests) -> None:
            while True:
                kids = waiting.setdefault((tree, n, level, parent), {})
                kids.update(zip(at, digests, strict=True))
                if len(kids) < min(arity, nodes_at(n, level - 1) - parent * arity):
                    return
                del waiting[tree, n, level, parent]
                children = [kids[k] for k in range(len(kids))]
                digest = hashlib.sha256("".join(children).encode()).hexdigest()
                is_root = nodes_at(n, level) == 1
                out.append((tree, n, level, parent, None, children, digest, is_root))
                if is_root:
                    return
                level, at, digests, parent = level + 1, [parent % arity], [digest], parent // arity

        def flush(everything: bool, but: tuple | None = None) -> pd.DataFrame:
            """Nodes made so far and, if asked, partial parents but the one whose pieces may still come."""
            if everything:
                rest = {but: waiting.pop(but)} if but in waiting else {}
                out.extend((*key, list(kids), list(kids.values()), None, False) for key, kids in waiting.items())
                waiting.clear()
                waiting.update(rest)
            made = pd.DataFrame(out, columns=["tree", "n", "level", "parent", "at", "children", "digest", "is_root"])
            out.clear()
            return made

        for frame in frames:
            for row in frame[["tree", "n", "level", "parent", "at", "children"]].itertuples(index=False, name=None):
                merge(*row)
            yield flush(len(waiting) > MOST_OPEN, row[:4] if len(frame) else None)
        yield flush(True)

    return run


def build(leaves: DataFrame, arity: int) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes above the leaves (tree, n, idx, digest) of all trees with more than one leaf, and the tables they lie in."""
    events = leaves.filter("n > 1").select(
        "tree", "n", F.lit(1).alias("level"), F.expr(f"idx div {arity}").alias("parent"), F.array((F.col("idx") % arity).cast("int")).alias("at"), F.array("digest").alias("children"))
    tables, top = [], 0
    while True:
        tables.append(shared_table(events.mapInPandas(_cascade(arity), EVENTS), "merkle-nodes"))
        open_ = tables[-1].filter("digest IS NULL")
        if open_.isEmpty():
            break
        top += LEVELS
        meet = F.expr(f"parent div cast(pow({arity}, greatest({top} - level, 0)) AS long)")
        # pieces of a parent lie side by side, so every round completes all parents that it is given
        events = open_.repartition(partitions_for(leaves), F.col("tree"), F.greatest("level", F.lit(top)), meet).sortWithinPartitions("tree", "level", "parent")
    nodes = tables[0]
    for more in tables[1:]:
        nodes = nodes.union(more)
    return nodes.filter("digest IS NOT NULL").withColumnRenamed("parent", "idx").drop("at"), tables


def step(children: Column, at: Column) -> Column:
    """Digests before and after child ``at`` of its parent."""
    text = lambda part: F.array_join(part, "")
    return F.struct(text(F.slice(children, 1, at)).alias("before"), text(F.slice(children, at + 2, F.greatest(F.size(children) - at - 1, F.lit(0)))).alias("after"))


def with_paths(leaves: DataFrame, nodes: DataFrame, roots: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with the columns of ``roots`` and ``path``: the steps from the leaf to its tree's root, then the root's.

    ``roots``: tree, path and more, a row a tree. Every level joins nodes with what their parents know of them, by tree and
    place, so keys are unique on both sides; what is joined last has a row for every ``arity`` leaves.
    """
    more = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for level in range(nodes.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = nodes.filter(F.col("level") == level)
        known = here.filter("is_root").select("tree", "idx").join(roots, "tree")
        if above is not None:
            child = F.posexplode("children").alias("_at", "_digest")
            below = above.select("*", child).select("tree", (F.col("idx") * arity + F.col("_at")).alias("idx"), F.concat(F.array(step(F.col("children"), F.col("_at"))), "path").alias("path"), *more)
            known = known.unionByName(below)
        above = here.select("tree", "idx", "children").join(known, ["tree", "idx"])
    single = leaves.filter("n = 1").select("tree").join(roots, "tree").select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "path", *more)
    runs = single if above is None else above.select(*single.columns).union(single)
    at = (F.col("idx") % arity).cast("int")
    own = F.when(F.col("_children").isNull(), F.col("_path")).otherwise(F.concat(F.array(step(F.col("_children"), at)), "_path"))
    runs = runs.withColumnsRenamed({"idx": "_run", "children": "_children", "path": "_path"})
    return leaves.withColumn("_run", F.expr(f"idx div {arity}")).join(runs, ["tree", "_run"]).withColumn("path", own).drop("_run", "_children", "_path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest_of(F.concat(s["before"], acc, s["after"])))


def merkle_manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = 16, changed: dict[str, Column] | None = None, changed_if: Column | None = None) -> DataFrame:
    """``order`` and leaf, subroot, root, path (array of before and after: the siblings), folded_root and verified of every row.

    ``changed`` holds new values of some fields for the rows where ``changed_if`` is true: the root is recomputed from
    the changed row and the manifest's siblings, and ``verified`` says whether it is still the manifest's root.
    """
    values = {f: F.col(f) for f in fields}
    other = F.when(changed_if, leaf_digest(values | changed)) if changed else F.lit(None).cast("string")
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = shared_table(docs.select(F.col(order).alias("_order"), tree.alias("tree"), leaf_digest(values).alias("digest"), other.alias("changed")), "merkle-leaves")
    leaves, placed = ranked(rows, ["_order", "digest"])
    nodes, made = build(leaves, arity)
    subroots = nodes.filter("is_root").select("tree", "digest").union(leaves.filter("n = 1").select("tree", "digest"))
    groups = shared_table(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "merkle-groups")
    tops, groups_placed = ranked(groups, ["group"])
    top_nodes, top_made = build(tops, arity)
    root = top_nodes.filter("is_root").select("digest").union(tops.filter("n = 1").select("digest")).first()
    root = F.lit(root[0] if root else None).cast("string")
    start = docs.sparkSession.createDataFrame([("", [])], "tree string, path array<struct<before string, after string>>")
    roots = shared_table(with_paths(tops, top_nodes, start, arity).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "path"), "merkle-roots")
    forget(rows, groups, groups_placed, *top_made)
    out = with_paths(leaves, nodes, roots, arity)
    back = folded(F.coalesce("changed", "digest"), F.col("path"))
    out = out.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: leaf, roots, proof and check after tampering of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle_manifest(docs, changed={"text": F.translate("text", UPPER, LOWER)}, changed_if=tampered)
    proof = digest_of(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def oracle(levels: int = 6, arity: int = 16) -> str:
    """DuckDB SQL of the query for trees of at most ``arity`` to the power of ``levels`` leaves."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))"
    fields = lambda text: " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""rows AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, sha256({fields('text')}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({fields(lower)}) END AS tampered FROM documents
), a0 AS (
    SELECT row_id, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS idx, leaf AS d, coalesce(tampered, leaf) AS f, '' AS proof FROM rows
)"""]  # fmt: skip

    def climb(prefix: str, k: int, key: str) -> str:
        """From nodes at a level (a row a leaf) to the next level; trees that have one node stay as they are."""
        return f"""{prefix}n{k} AS (SELECT DISTINCT tree, idx, d FROM {prefix}{k}), {prefix}r{k} AS (
    SELECT tree, idx // {arity} AS p, list(d ORDER BY idx) AS kids, sum(count(*)) OVER (PARTITION BY tree) AS n FROM {prefix}n{k} GROUP BY tree, idx // {arity}
), {prefix}{k + 1} AS (
    SELECT x.{key}, x.tree, CASE WHEN n = 1 THEN x.idx ELSE p END AS idx, CASE WHEN n = 1 THEN x.d ELSE sha256(array_to_string(kids, '')) END AS d,
        CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(list_slice(kids, 1, place), '') || f || array_to_string(list_slice(kids, place + 2, {arity}), '')) END AS f,
        CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(list_slice(kids, 1, place), '') || array_to_string(list_slice(kids, place + 2, {arity}), '') END AS proof
    FROM (SELECT *, idx % {arity} AS place FROM {prefix}{k}) x JOIN {prefix}r{k} r ON x.tree = r.tree AND x.idx // {arity} = r.p
)"""

    parts += [climb("a", k, "row_id") for k in range(levels)]
    parts.append(f"b0 AS (SELECT row_id, '' AS tree, dense_rank() OVER (ORDER BY tree) - 1 AS idx, d, f, proof FROM a{levels})")
    parts += [climb("b", k, "row_id") for k in range(levels)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT r.doc_id, r.leaf, a.d AS subroot, b.d AS root, sha256(b.proof) AS proof_sha256, b.f AS folded_root, b.f = b.d AS verified
FROM rows r JOIN a{levels} a USING (row_id) JOIN b{levels} b USING (row_id)"""  # fmt: skip
