"""Scoring texts with a log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model predicts a word from the words before it: their vectors, each scaled for its distance, add up to a prediction,
whose products with the vectors of what may follow, normalised by batched matrix products, are log-probabilities. The
output has two levels: classes, then the words of a class. The most frequent words are classes of their own, the next
ones (their number grows with the vocabulary) share classes of about equal cost, in which their own vectors decide; the
rare rest is in classes by endings, in which a word has its add-one relative frequency. All factors are normalised, and
so is their product over known words and one unknown word a rest class.

Texts are cut into words once to count them and once to write them as numbers, which training and scoring read. Word
counts, class sizes and training cover all training rows; each task trains on its rows from common parameters and
Spark averages what the tasks found, a word's vectors over the tasks that saw it. The most frequent words (``HEAD``, of at
most ``HEAD_BYTES`` bytes) are broadcast; all others meet their counts in a join.

Null texts count as empty: one end token. Repeated rows count and are scored as often as they come. Without training
rows all counts are zero and classes are equally likely. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fewer_collections, hot_join, remainder, shared_table, utf8

END = b"\n"  # no word holds it
HEAD, HEAD_BYTES = 200_000, 48
#: Words that are classes, and classes of the rare rest; words with vectors: at least and at most.
SINGLE, REST, LEAST_WORDS, MOST_WORDS = 64, 64, 1024, 65_000
WIDTH, CONTEXT = 24, 4
BATCH, NOISE, RATIO, RATE = 2048, 64, 20.0, 0.12
#: Words of which a task sends the vectors together.
BLOCK = 256


def tokens(raw: bytes) -> list[bytes]:
    """ASCII lower-cased words and the end."""
    return [*raw.lower().split(), END]


def words_for(distinct: int) -> int:
    """Words with vectors of their own, for a vocabulary of ``distinct`` words: 16 times its root, within bounds."""
    return int(min(MOST_WORDS, max(LEAST_WORDS, 16 * np.sqrt(distinct))))


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts (column raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        held: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                held.update(tokens(raw.as_py()))
                if len(held) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.select("raw").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks need of the counts. The first ``words`` of the head have vectors; ``of_word`` has their classes."""

    head: dict[bytes, int]
    counts: np.ndarray  # of the head's words
    words: int
    of_word: np.ndarray
    edges: np.ndarray  # first word of each class of several words, and the end
    weight: np.ndarray  # tokens of each class
    inner: np.ndarray  # log10 of the denominator within each class of the rest
    total: int
    distinct: int

    def __post_init__(self):
        behind = [self.words + zlib.crc32(w[-2:]) % REST for w in islice(self.head, self.words, None)]
        self.of_head = np.concatenate([np.arange(self.words), np.array(behind, np.int64)])

    @property
    def rest(self) -> int:
        """The first class of the rest."""
        return len(self.weight) - REST

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Places in the head, -1 for other words."""
        return np.fromiter(map(self.head.get, words, repeat(-1)), np.int64, len(words))

    def units(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """A number for each word's vector: its place, if it has one, or that of its class of the rest behind them."""
        found = self.of_head.take(ids)
        for k in np.flatnonzero(ids < 0).tolist():
            found[k] = self.words + zlib.crc32(words[k][-2:]) % REST
        return found

    def classes(self, units: np.ndarray) -> np.ndarray:
        return np.where(units < self.words, self.of_word[np.minimum(units, self.words - 1)], units - self.words + self.rest)


def vocabulary(words: DataFrame) -> Vocabulary:
    """The vocabulary of a table of counts (word, n)."""
    ending = (F.crc32(F.expr("substring(word, -2, 2)")) % F.lit(REST)).cast("int")
    grouped = words.groupBy(ending.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row a class
    short = words.filter(F.length("word") <= HEAD_BYTES)
    size = {r["k"]: r["v"] for r in short.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("v")).collect()}  # eight rows a power of two
    least, held = max(size, default=0) + 1, 0
    for k in sorted(size, reverse=True):
        held += size[k]
        if held > HEAD:
            break
        least = k
    top = sorted(short.filter(F.floor(F.log2("n") * 8) >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))  # HEAD rows at most
    own = [(END, next((r["n"] for r in top if bytes(r["word"]) == END), 0)), *((bytes(r["word"]), r["n"]) for r in top if bytes(r["word"]) != END)]
    counts = np.array([c for _, c in own], np.int64)
    n, v = np.zeros(REST), np.zeros(REST)
    for r in grouped:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    total, distinct = int(n.sum()), int(v.sum())
    having = min(len(own), words_for(distinct))
    for w, c in own[:having]:  # what has a vector isn't in the rest
        if c:
            k = zlib.crc32(w[-2:]) % REST
            n[k], v[k] = n[k] - c, v[k] - 1
    several = np.sqrt(counts[SINGLE:having].astype(float))
    groups = max(1, int(np.sqrt(len(several))))
    cut = np.searchsorted(np.cumsum(several), several.sum() * np.arange(1, groups) / groups) if len(several) else []
    edges = np.unique(np.concatenate([[0], cut, [len(several)]])).astype(np.int64) + min(SINGLE, having)
    of_word = np.concatenate([np.arange(min(SINGLE, having)), np.repeat(np.arange(len(edges) - 1), np.diff(edges)) + min(SINGLE, having)]).astype(np.int64)
    weight = np.concatenate([np.bincount(of_word, counts[:having], min(SINGLE, having) + len(edges) - 1), n])
    return Vocabulary({w: k for k, (w, _) in enumerate(own)}, counts, having, of_word, edges, weight, np.log10(n + v + 1), total, distinct)


class LogBilinear:
    """Vectors Q of what comes before, with a scale for each distance; vectors C of classes and W of words, which end in a bias.

    Predictions end in a one, so that their products with C and W hold the biases.
    """

    def __init__(self, vocab: Vocabulary, seed: int = 5):
        rng, n, m = np.random.default_rng(seed), len(vocab.weight), vocab.words
        self.edges, self.single, self.of_word = vocab.edges, int(vocab.edges[0]), vocab.of_word
        self.class_noise = (vocab.weight + 1) / (vocab.weight + 1).sum()
        several = vocab.counts[:m] + 1.0
        several[: self.single] = 0
        self.word_noise = several / max(several.sum(), 1)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        biased = lambda x, share: np.column_stack([x, np.log(np.maximum(share, 1e-12))]).astype(np.float32)
        self.Q = normal(m + REST, WIDTH)
        self.C, self.W = biased(normal(n, WIDTH), self.class_noise), biased(normal(m, WIDTH), self.word_noise)
        self.scale = np.ones((CONTEXT, WIDTH), np.float32) / CONTEXT

    def start_training(self) -> None:
        self.grown = {k: np.ones_like(getattr(self, k)) for k in ("Q", "C", "W", "scale")}
        self.met = np.zeros(len(self.Q), np.int64)

    def predict(self, before: np.ndarray) -> np.ndarray:
        """Predicted vectors; before: for each distance the units of all rows."""
        out = self.Q[before[0]] * self.scale[0]
        for i in range(1, CONTEXT):
            out += self.Q[before[i]] * self.scale[i]
        return with_one(out)

    def window(self, units: np.ndarray, at: int, n: int) -> np.ndarray:
        """Vectors of the units from ``CONTEXT`` before ``at`` on; row CONTEXT + t - 1 - i is the i-th before the t-th."""
        low = max(0, at - CONTEXT)
        near = self.Q.take(units[low : at + n], 0)
        return near if low + CONTEXT == at else np.concatenate([np.zeros((CONTEXT - at + low, WIDTH), np.float32), near])

    def predictions(self, units: np.ndarray, places: np.ndarray, at: int, n: int, near: np.ndarray) -> np.ndarray:
        """Predictions of the units from ``at`` on in texts laid end to end; places: their places in their texts."""
        sums = near[CONTEXT - 1 : CONTEXT - 1 + n] * self.scale[0]
        for i in range(1, CONTEXT):
            sums += near[CONTEXT - 1 - i : CONTEXT - 1 - i + n] * self.scale[i]
        out = with_one(sums)
        few = np.flatnonzero(places[at : at + n] < CONTEXT)
        if len(few):
            out[few] = self.predict(contexts(units, places, at + few))
        return out

    def text_log10(self, units: np.ndarray, places: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """``log10_probabilities`` of the tokens of texts laid end to end."""
        guess = np.empty((len(units), WIDTH + 1), np.float32)
        for at in range(0, len(units), 4096):
            n = min(4096, len(units) - at)
            guess[at : at + n] = self.predictions(units, places, at, n, self.window(units, at, n))
        return self.log10_probabilities(guess, classes, units)

    def log10_probabilities(self, guess: np.ndarray, classes: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class, times that of the word in a class of several words with vectors."""
        out, products = np.empty(len(classes)), np.ascontiguousarray(self.C.T)
        far = float(np.sqrt(np.einsum("nd,nd->n", guess, guess).max(initial=0)))
        high = lambda vectors: far * float(np.sqrt((vectors[:, :WIDTH] ** 2).sum(1).max())) + float(vectors[:, WIDTH].max())
        safe = high(self.C) < 60
        for at in range(0, len(classes), 512):
            part = slice(at, at + 512)
            out[part] = log_softmax(guess[part] @ products, classes[part], safe)
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        last = self.single + len(self.edges) - 1
        cuts = np.searchsorted(classes[order], np.arange(self.single, last + 1))
        for g, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            a, b = int(self.edges[g]), int(self.edges[g + 1])
            if lo == hi:
                continue
            step, safe = max(64, (1 << 17) // (b - a)), high(self.W[a:b]) < 60
            for at in range(lo, hi, step):
                rows = order[at : min(hi, at + step)]
                out[rows] += log_softmax(guess.take(rows, 0) @ self.W[a:b].T, units[rows] - a, safe)
        return out / np.log(10)

    def push(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        """One AdaGrad step on the rows of a parameter; the gradients of a repeated row add up."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix; there are fewer units than that
        rows = rows[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, used, grown, values = np.add.reduceat(grads.take(order, 0), start, axis=0), rows[start], self.grown[name], getattr(self, name)
        squares = grown.take(used, 0)
        squares += g * g
        grown[used] = squares
        g *= RATE
        g /= np.sqrt(squares, out=squares)
        values[used] = values.take(used, 0) - g

    def contrast(self, p: np.ndarray, target: np.ndarray, name: str, noise: np.ndarray, share: np.ndarray) -> np.ndarray:
        """One step of noise-contrastive estimation on the outputs; returns the gradient of the predictions ``p``."""
        V = getattr(self, name)
        lift = np.log(RATIO * share).astype(np.float32)
        own, other = V.take(target, 0), V[noise]
        good = -1 / (1 + np.exp(np.einsum("nd,nd->n", p, own) - lift.take(target)))
        away = -other
        away[:, WIDTH] += lift[noise]
        bad = p @ away.T
        np.exp(bad, out=bad)
        bad += 1
        np.divide(np.float32(RATIO / NOISE), bad, out=bad)
        own *= good[:, None]
        own += bad @ other
        self.push(name, np.concatenate([target, noise]), np.concatenate([p * good[:, None], bad.T @ p]))
        return own[:, :WIDTH]

    def train(self, units: np.ndarray, places: np.ndarray, classes: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the tokens of texts laid end to end, in batches; the noise of a batch is shared by its tokens."""
        cuts = np.cumsum(self.class_noise), np.cumsum(self.word_noise)
        draw = lambda k, n: np.minimum(np.searchsorted(cuts[k], rng.random(NOISE) * cuts[k][-1], "right"), n - 1)
        self.met += np.bincount(units, minlength=len(self.met))
        for at in range(0, len(units), BATCH):
            t, u = classes[at : at + BATCH], units[at : at + BATCH]
            n = len(t)
            near = self.window(units, at, n)
            p = self.predictions(units, places, at, n, near)
            dp = np.ascontiguousarray(self.contrast(p, t, "C", draw(0, len(self.C)), self.class_noise))
            several = np.flatnonzero((t >= self.single) & (t < self.single + len(self.edges) - 1))
            if len(several):
                dp[several] += self.contrast(p.take(several, 0), u[several], "W", draw(1, len(self.W)), np.maximum(self.word_noise, 1e-12))
            # What a unit gets from the predictions after it; what lies before a text's start is its end token's.
            gained, scale = np.zeros((n + CONTEXT, WIDTH), np.float32), np.empty((CONTEXT, WIDTH), np.float32)
            ends = np.zeros((1, WIDTH), np.float32)
            for i in range(CONTEXT):
                shift = slice(CONTEXT - 1 - i, CONTEXT - 1 - i + n)
                mine = dp * self.scale[i]
                scale[i] = np.einsum("nd,nd->d", dp, near[shift])
                early = np.flatnonzero(places[at : at + n] <= i)
                if len(early):
                    scale[i] += (dp[early] * (self.Q[0] - near[shift][early])).sum(0)
                    ends += mine[early].sum(0)
                    mine[early] = 0
                gained[shift] += mine
            low = max(0, at - CONTEXT)
            self.push("Q", np.append(units[low : at + n], 0), np.concatenate([gained[CONTEXT - at + low :], ends]))
            self.grown["scale"] += scale**2
            self.scale -= RATE * scale / np.sqrt(self.grown["scale"])

    def parts(self, seen: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, values, weights) of what training changed: the small parameters, and blocks of words that were met."""
        small = np.concatenate([self.C.ravel(), self.scale.ravel()])
        yield -1, small.tobytes(), np.full(1, seen, float).tobytes()
        for k in range(0, len(self.Q), BLOCK):
            weight = self.met[k : k + BLOCK].astype(float)
            if weight.any():
                yield k // BLOCK, self.rows(k).tobytes(), weight.tobytes()

    def rows(self, k: int) -> np.ndarray:
        """Q and W of a block of words; what lies in the rest has no W."""
        q = self.Q[k : k + BLOCK]
        out = np.zeros((len(q), 2 * WIDTH + 1), np.float32)
        out[:, :WIDTH] = q
        w = self.W[k : k + BLOCK]
        out[: len(w), WIDTH:] = w
        return out

    def load(self, block: int, values: np.ndarray, weights: np.ndarray) -> None:
        """Take the mean that tasks found."""
        if block < 0:
            for x, part in zip((self.C, self.scale), np.split(values, [self.C.size]), strict=True):
                x[:] = part.reshape(x.shape)
            return
        k, met = block * BLOCK, weights > 0
        rows = values.reshape(-1, 2 * WIDTH + 1)
        self.Q[k : k + BLOCK][met] = rows[met, :WIDTH]
        n = len(self.W[k : k + BLOCK])
        self.W[k : k + BLOCK][met[:n]] = rows[:n][met[:n], WIDTH:]


def with_one(vectors: np.ndarray) -> np.ndarray:
    """The vectors, each with a one at its end."""
    out = np.empty((len(vectors), WIDTH + 1), np.float32)
    out[:, :WIDTH], out[:, WIDTH] = vectors, 1
    return out


def log_softmax(scores: np.ndarray, target: np.ndarray, safe: bool) -> np.ndarray:
    """Natural log of the normalised probability of each row's target; overwrites the scores. safe: exp can't overflow."""
    own = scores[np.arange(len(target)), target].astype(float)
    if not safe:
        top = scores.max(1)
        scores -= top[:, None]
        own -= top
    np.exp(scores, out=scores)
    return own - np.log(scores.sum(1))


def places_of(sizes: np.ndarray) -> np.ndarray:
    """The places of all tokens in their texts, for texts of these sizes laid end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def contexts(units: np.ndarray, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each distance the units before some tokens of texts laid end to end; before a text's start, the end token."""
    back = rows - 1 - np.arange(CONTEXT)[:, None]
    return np.where(places[rows] > np.arange(CONTEXT)[:, None], units[np.maximum(back, 0)], 0)


def groups(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[tuple[list, list, list[bytes]]]:
    """(ids, flags, texts) of bounded size from batches of (id, flag, raw)."""
    for batch in batches:
        keys, flags, raws, held = [], [], [], 0
        for key, flag, raw in zip(*batch.columns, strict=True):
            keys.append(key.as_py())
            flags.append(flag.as_py())
            raws.append(raw.as_py())
            held += len(raws[-1])
            if held > limit:
                yield keys, flags, raws
                keys, flags, raws, held = [], [], [], 0
        if keys:
            yield keys, flags, raws


#: Tokens that are trained on, or scored, together.
TOGETHER = 1 << 17


def unit_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, sizes, units) of about ``TOGETHER`` tokens from batches whose last column has the units of each text."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 2 for x in batch.column(batch.num_columns - 1)], np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            part = batch.slice(at, to - at)
            units = np.frombuffer(b"".join(x.as_buffer() for x in part.column(batch.num_columns - 1)), "<u2").astype(np.int64)
            yield part, sizes[at:to], units
            at = to


def average_pass(encoded: DataFrame, words, model: LogBilinear) -> LogBilinear:
    """Every task trains on its texts (units) from ``model``; the result is the mean, weighted by tokens, or by a word's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        vocab, own, seen = words.value, model, 0
        own.start_training()
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for _, sizes, units in unit_groups(batches):
            own.train(units, places_of(sizes), vocab.classes(units), rng)
            seen += len(units)
        if seen:
            for row in own.parts(seen):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, values, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w = np.frombuffer(weights)
                v = np.frombuffer(values, np.float32).reshape(len(w), -1) * w[:, None]
                old = sums.get(block, (0.0, 0.0))
                sums[block] = (old[0] + v, old[1] + w)
        for block, (v, w) in sums.items():
            row = (block, (v / np.maximum(w, 1e-9)[:, None]).astype(np.float32).tobytes(), w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    names, schema = ["block", "v", "w"], "block int, v binary, w binary"
    got = encoded.select("units").mapInArrow(run, schema).repartition("block").mapInArrow(mean, schema).collect()  # the parameters once
    for r in got:
        model.load(r["block"], np.frombuffer(r["v"], np.float32), np.frombuffer(r["w"]))
    return model


def score_texts(docs: DataFrame, training: Column, passes: tuple[Column, ...] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows where ``training`` holds.

    passes: conditions on doc_id of the training rows of each round of averaging.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("raw"))
    counts = shared_table(count_words(rows.filter(training)), "words")
    vocab = vocabulary(counts)
    words = spark.sparkContext.broadcast(vocab)
    total, whole = vocab.total, float(np.log10(vocab.total + vocab.distinct + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, with all that needs no model, and a row for each of its words outside the head."""
        fewer_collections()
        vocab, at = words.value, TaskContext.get().partitionId() << 40
        for keys, learn, raws in groups(batches):
            split = [tokens(r) for r in raws]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            flat = [w for ws in split for w in ws]
            ids = vocab.ids(flat)
            units = vocab.units(flat, ids)
            counts = np.where(ids < 0, 0, vocab.counts[ids])
            one = np.log10(counts + 1)
            outer = units >= vocab.words  # of the rest: the relative frequency in the class
            inner = np.where(outer, one - vocab.inner[np.where(outer, units - vocab.words, 0)], 0)
            start = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, start) for x in (one, inner, (counts > 0).astype(np.int64))]
            row = at + np.arange(len(keys))
            at += len(keys)
            tail = np.flatnonzero(ids < 0)
            often = Counter(zip(np.repeat(row, sizes)[tail].tolist(), map(flat.__getitem__, tail.tolist()), strict=True))
            where, word = zip(*often, strict=True) if often else ((), ())
            none, n = [None] * len(keys), len(often)
            packed, ends = units.astype("<u2").tobytes(), (np.cumsum(sizes) * 2).tolist()
            texts = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            columns = [
                pa.array([*row.tolist(), *where], pa.int64()), pa.array([*none, *word], pa.binary()), pa.array([*none, *often.values()], pa.int64()),
                *(pa.concat_arrays([pa.array(x, t), pa.nulls(n, t)]) for x, t in (
                    (keys, pa.int64()), (learn, pa.bool_()), (sizes, pa.int64()), (sums[0], pa.float64()), (sums[1], pa.float64()), (sums[2], pa.int64()), (texts, pa.binary()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "word", "k", "doc_id", "learn", "n_tokens", "log_counts", "log_inner", "known", "units"])

    schema = "row long, word binary, k long, doc_id long, learn boolean, n_tokens long, log_counts double, log_inner double, known long, units binary"
    made = shared_table(rows.withColumn("learn", F.coalesce(training, F.lit(False))).select("doc_id", "learn", "raw").mapInArrow(encode, schema), "units")
    encoded = made.filter(F.col("n_tokens").isNotNull()).drop("word", "k")
    model = LogBilinear(vocab)
    for chosen in passes or (F.lit(True),):
        model = average_pass(encoded.filter("learn").filter(chosen), words, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        for part, sizes, units in unit_groups(batches):
            logs = np.add.reduceat(model.text_log10(units, places_of(sizes), vocab.classes(units)), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(logs + part.column(part.num_columns - 2).to_numpy())], ["row", "doc_id", "n_tokens", "log_counts", "known", "log_rest"])

    rare = hot_join(made.filter(F.col("word").isNotNull()).select("row", "word", "k"), counts, "word", "row")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1) * F.col("k")).alias("more_logs"), F.sum("k").alias("more_known"))
    scored = encoded.select("row", "doc_id", "n_tokens", "log_counts", "known", "log_inner", "units").mapInArrow(score, "row long, doc_id long, n_tokens long, log_counts double, known long, log_rest double")
    out = scored.join(rare, "row", "left")
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * whole).alias("base_score"), (F.coalesce("more_logs", F.lit(0.0)) + F.col("log_rest")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language model's and the base's score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = remainder("doc_id", 7)
    scored = score_texts(docs, part != 2, (part == 0, F.lit(True)))
    return scored.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
