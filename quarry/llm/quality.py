"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Pairs of features interact through low-rank factors; the sum-of-squares identity makes a score linear in the number of
features. The model is fitted on a bounded sample of labelled rows (``sample``, least hashes of doc_id first) and scores
every whole text.

Null texts count as empty; an empty text has statistics of zero and gets a score like any other. A document labelled
more than once counts as its highest label, one with several texts teaches one of them. Without labelled rows, or with one class only, the score is the share of
label 1 (0.5 without rows). Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fewer_collections, kept_columns, remainder, schema_of, utf8

BUCKETS, RANK, STATS = 1 << 13, 6, 24
MARKS = b"!$%&*#|.,;:?@/\\<>={}[]_"
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20


class Buckets(dict):
    """Word to hash bucket; of about ``BUCKET_BYTES`` at most."""

    used = 0

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % BUCKETS
        self.used += len(word) + 180
        if self.used > BUCKET_BYTES:
            self.clear()
            self.used = len(word) + 180
        self[word] = found
        return found


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Shares of kinds of bytes, word and line shapes, repetition and length of one text."""
    n, w = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    marks = seen[np.frombuffer(MARKS, np.uint8)]
    lines = raw.split(b"\n")
    return [
        seen[65:91].sum() / n, seen[97:123].sum() / n, seen[48:58].sum() / n, seen[128:].sum() / n, seen[32] / n, seen[10] / n * 10,
        marks.sum() / n, *(marks[:8] / n), marks[8:].sum() / n, seen[:9].sum() / n,
        len(raw) / w / 10, len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 5,
        float(len(words) == 0),
    ]


def features(raws: list[bytes], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and values of the words (unit length a row), and the matrix of statistics."""
    ids, sizes, stats = [], [], []
    for raw in raws:
        words = raw.lower().split()
        ids.append(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        stats.append(statistics(raw, words))
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(raws)), sizes) * BUCKETS + flat, return_counts=True)
    row, bucket = keys // BUCKETS, keys % BUCKETS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value**2, len(raws)))
    return row, bucket, value / np.maximum(norm[row], 1e-9), np.array(stats, float).reshape(-1, STATS)


class FactorMachine:
    """w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2); words first, then standardised statistics."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(BUCKETS + STATS)
        self.factors = rng.normal(0, 0.05, (BUCKETS + STATS, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)

    def sums(self, n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the factor sums of each row."""
        start = np.searchsorted(row, np.arange(n + 1))
        has = np.flatnonzero(np.diff(start))
        each = np.concatenate([(value * self.linear[bucket])[:, None], self.factors[bucket] * value[:, None]], 1)
        total, squares = np.zeros((n, 1 + RANK)), np.zeros(n)
        if len(has):
            total[has] = np.add.reduceat(each, start[has], axis=0)
            squares[has] = np.add.reduceat((each[:, 1:] ** 2).sum(1), start[has])
        v, w = self.factors[BUCKETS:], self.linear[BUCKETS:]
        pull = total[:, 1:] + stats @ v
        return self.bias + total[:, 0] + stats @ w + 0.5 * ((pull**2).sum(1) - squares - (stats**2) @ (v**2).sum(1)), pull

    def scores(self, raws: list[bytes], buckets: Buckets) -> np.ndarray:
        row, bucket, value, stats = features(raws, buckets)
        return 1 / (1 + np.exp(-self.sums(len(raws), row, bucket, value, self.dense(stats))[0]))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, size: int = 64, rate: float = 0.06, decay: float = 1e-5, seed: int = 11) -> FactorMachine:
        """Log loss by AdaGrad over mini-batches. rows: buckets, values and raw statistics of each labelled text."""
        share = labels.mean() if len(labels) else 0.5
        if len(labels) == 0 or share in (0.0, 1.0):
            self.bias, self.linear[:], self.factors[:] = np.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0
            return self
        stats = np.stack([r[2] for r in rows])
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-3
        self.bias = float(np.log(share / (1 - share)))
        dense, rng = self.dense(stats), np.random.default_rng(seed)
        g0, g1, g2 = 1e-6, np.full(BUCKETS + STATS, 1e-6), np.full((BUCKETS + STATS, RANK), 1e-6)
        own = np.arange(BUCKETS, BUCKETS + STATS)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), size):
                batch = order[at : at + size]
                row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                bucket, value = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
                raw, pull = self.sums(len(batch), row, bucket, value, dense[batch])
                error = (1 / (1 + np.exp(-raw)) - labels[batch]) / len(batch)
                index = np.concatenate([bucket, np.tile(own, len(batch))])
                row = np.concatenate([row, np.repeat(np.arange(len(batch)), STATS)])
                value = np.concatenate([value, dense[batch].ravel()])
                pushed = (error[row] * value)[:, None]
                grown = pushed * (pull[row] - self.factors[index] * value[:, None])
                used, to = np.unique(index, return_inverse=True)
                d1 = np.bincount(to, pushed[:, 0]) + decay * self.linear[used]
                d2 = np.stack([np.bincount(to, grown[:, f]) for f in range(RANK)], 1) + decay * self.factors[used]
                d0 = error.sum()
                g0 += d0**2
                g1[used] += d1**2
                g2[used] += d2**2
                self.bias -= rate * d0 / np.sqrt(g0)
                self.linear[used] -= rate * d1 / np.sqrt(g1[used])
                self.factors[used] -= rate * d2 / np.sqrt(g2[used])
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 12_000) -> FactorMachine:
    """Fit on at most ``sample`` labelled rows for which ``usable`` (a condition on doc_id) holds."""
    known = labels.filter(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", utf8().alias("raw")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            out = []
            for doc_id, quality, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                _, bucket, value, stats = features([raw], buckets)
                out.append((doc_id, quality, bucket.astype("<i4").tobytes(), value.astype("<f4").tobytes(), stats.astype("<f8").tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "quality", "b", "v", "s"])

    made = texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "raw").mapInArrow(run, "doc_id long, quality int, b binary, v binary, s binary")
    # A doc_id that comes with several texts teaches one of them, so ``sample`` rows come to the driver at most.
    got = sorted(r["row"] for r in made.groupBy("doc_id").agg(F.min(F.struct("b", "v", "s", "quality")).alias("row")).collect())
    rows = [(np.frombuffer(r["b"], "<i4").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(float), np.frombuffer(r["s"], "<f8")) for r in got]
    return FactorMachine().fit(rows, np.array([r["quality"] for r in got], float))


def score_quality(docs: DataFrame, model: FactorMachine, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (or all) and score for every row; ``score`` is the model's probability of label 1."""
    kept = kept_columns(docs, keep, ["score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        fewer_collections()
        for batch in batches:
            raws, scores, held = [], [], 0
            for raw in batch.column(len(kept)):
                raws.append(raw.as_py())
                held += len(raws[-1])
                if held > GROUP_BYTES:
                    scores.append(model.scores(raws, buckets))
                    raws, held = [], 0
            if raws:
                scores.append(model.scores(raws, buckets))
            found = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], [*kept, "score"])

    return docs.select(*kept, utf8().alias("_raw")).mapInArrow(run, schema_of(docs, kept, "score double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(docs, labels, remainder("doc_id", 5) != 0), ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
