"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps modular prefix sums of a text, from which the hash of any span follows in constant time; equality
of spans and longest common extensions build on it. A fingerprint is the hash of the whole text, its length, and the
``KEEP`` smallest different hashes of its ``WINDOW``-character spans; the likeness of two fingerprints estimates the
Jaccard similarity of their texts' spans.

Null texts count as empty: their fingerprint has no span hashes, and two of them are alike (1.0). Rows that repeat a
doc_id are ordered by text. The last document's next is the first. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, worker_cache

PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
WINDOW, KEEP = 12, 64
#: Stands for a null doc_id, which sorts first.
NO_ID = -(1 << 63)
#: Powers of so many places are kept; those of longer texts are made for the text alone.
KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base and of its inverse, modulo the prime; grown by doubling and kept up to a bound."""
    kept = worker_cache("fingerprints", dict)
    have = kept.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, PRIME)):
            table = np.ones(size, np.int64)
            k = 1
            while k < size:
                table[k : 2 * k] = table[:k] * pow(b, k, PRIME) % PRIME
                k *= 2
            tables.append(table)
        have = (tables[0], tables[1])
        if size <= KEPT_POWERS:
            kept[base] = have
    return have


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class PrefixHash:
    """Prefix arrays of a text's code points; spans are compared by two hashes modulo 2**31 - 1."""

    def __init__(self, points: np.ndarray, bases: tuple[int, ...] = BASES):
        self.n = len(points)
        self.bases = bases
        self.sums = []
        self.down = []
        for base in bases:
            up, down = powers(base, self.n + 1)
            self.down.append(down)
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum((points + 1) * up[: self.n] % PRIME, out=sums[1:])
            self.sums.append(sums % PRIME)

    def spans(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of the spans [start, stop), each independent of where the span lies."""
        return (self.sums[k][stop] - self.sums[k][start]) % PRIME * self.down[k][start] % PRIME

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        return tuple((int(s[stop]) - int(s[start])) % PRIME * int(d[start]) % PRIME for s, d in zip(self.sums, self.down, strict=True))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` code points; of the whole text if it is shorter."""
        if not self.n:
            return np.empty(0, np.int64)
        width = min(width, self.n)
        return (self.sums[0][width:] - self.sums[0][:-width]) % PRIME * self.down[0][: self.n - width + 1] % PRIME


def same_span(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common run from a[i] and b[j], by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible mix of 32-bit values, so that the smallest are a random choice."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def sketch(hashes: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` smallest different values."""
    x = mixed(hashes)
    take = 2 * keep
    while len(x) > take:
        low = np.unique(np.partition(x, take)[:take])
        if len(low) >= keep:
            return low[:keep]
        take *= 4
    return np.unique(x)[:keep]


def parts(points: np.ndarray) -> tuple[str, np.ndarray, PrefixHash]:
    """Fingerprint, span hashes and prefix arrays of a text."""
    held = PrefixHash(points)
    low = sketch(held.windows(WINDOW))
    whole = "".join(f"{int(s[-1]):08x}" for s in held.sums)
    return f"{whole}{len(points):x}-{low.astype('>u4').tobytes().hex()}", low, held


def equal_texts(a: PrefixHash, b: PrefixHash) -> bool:
    return a.n == b.n and same_span(a, 0, b, 0, a.n)


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Share of the smallest values of both together that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = np.unique(np.concatenate([a, b]))[:keep]
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    x, y = (np.frombuffer(bytes.fromhex(s.split("-")[1]), ">u4").astype(np.uint32) for s in (a, b))
    return 1.0 if a == b else likeness(x, y)


def with_next(docs: DataFrame, cells: int) -> DataFrame:
    """doc_id, text dealt into ranges of doc_id; the first row of each range also follows, marked, the range before.

    The one exchange carries each text once, and a range's stream then shows every document with its next.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    share = [k / cells for k in range(1, cells)]
    if docs.isEmpty():
        return docs.withColumns({"cell": F.lit(0), "tail": F.lit(False)})
    cuts = docs.approxQuantile("doc_id", share, 0.2 / cells) if share else []
    top = np.iinfo(np.int64).max  # the cuts are doubles: any split of the ids will do, but no document need have one
    edges = np.array(sorted({min(int(x), int(top)) for x in cuts}), np.int64)

    @F.pandas_udf("int")
    def cell_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    here = docs.withColumn("cell", cell_of("doc_id"))
    found = sorted((r["cell"], r["first"]) for r in here.groupBy("cell").agg(F.min("doc_id").alias("first")).collect())  # ``cells`` rows at most
    held, firsts = np.array([c for c, _ in found], np.int32), np.array([f for _, f in found], np.int64)

    @F.pandas_udf("int")
    def back_of(ids: pd.Series) -> pd.Series:
        own = ids.to_numpy(np.int64)
        at = np.searchsorted(firsts, own, "right") - 1
        return pd.Series(held[at - 1]).where(pd.Series(firsts[at] == own), None).astype("Int32")

    back = back_of("doc_id")
    own = F.struct(F.col("cell"), F.lit(False).alias("tail"))
    also = F.struct(F.col("back").cast("int").alias("cell"), F.lit(True).alias("tail"))
    places = F.when(F.col("back").isNull(), F.array(own)).otherwise(F.array(own, also))
    return here.withColumn("back", back).select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.*")


def fingerprint_edits(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (the edited text), fingerprint, edited_fingerprint, near_edited, near_next, same_edited, same_next.

    near: likeness of the fingerprints, 1 if spans over the whole texts are equal; same: code points that the text shares
    with the other from the start, by longest common extension.
    """
    cells = cells or partitions_for(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the document whose next is still to come
        rows: list[tuple] = []
        size = 0

        def close(now: tuple) -> None:
            nonlocal size
            doc_id, points, own, low, held = before[1:]
            half = len(points) // 2
            changed = np.concatenate([points[: len(points) - half], now[2][:half]])
            edited, edited_low, edited_held = parts(changed)
            near = [1.0 if equal_texts(held, x) else likeness(low, y) for x, y in ((edited_held, edited_low), (now[5], now[4]))]
            starts = [longest_common_extension(held, 0, x, 0) for x in (edited_held, now[5])]
            text = changed.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            rows.append((doc_id, len(points), text, own, edited, *near, *starts))
            size += len(text)

        for batch in batches:
            for cell, tail, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if tail and (before is None or before[0] != cell):
                    continue
                points = codes(text)
                now = (cell, doc_id, points, *parts(points))
                if before is not None and before[0] == cell:
                    close(now)
                before = None if tail else now
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
        if rows:  # the last documents of the stream
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    dealt = with_next(docs, cells).repartition(cells, "cell").sortWithinPartitions("cell", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"
    made = dealt.select("cell", "tail", "doc_id", "text").mapInArrow(run, schema)
    return made.withColumn("doc_id", F.when(F.col("doc_id") > NO_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: fingerprints of every document and of its edited text, with their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_edits(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next")
