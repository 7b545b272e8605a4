"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans of mixed text.

Every word gets a score for each language from hashed byte n-grams, counted over all training rows. A path through the
languages pays ``penalty`` for each switch; the best path labels every word. The language of a text is the one with most
labelled letters, its score that share of the letters.

Null texts, empty ones and texts without a letter get ``und`` with score 0, as does every text when nothing could be
learned. Rows with a null lang teach nothing. Repeated rows are counted and predicted like others.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, fewer_collections, kept_columns, remainder, schema_of, worker_cache

BUCKETS = 1 << 14
#: First and last code points of scripts; fixed values of the Unicode standard.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
NAMES = list(SCRIPTS)
RANGES = sorted((a, b, k) for k, name in enumerate(NAMES) for a, b in SCRIPTS[name])
STARTS, STOPS, WHICH = (np.array([r[k] for r in RANGES]) for k in range(3))
#: ASCII bytes that are no letters end a word.
BREAKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: First and last code points of scripts without spaces; each of their letters is a word. Fixed values of the Unicode standard.
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


class Letters(dict):
    """Code point to itself (a letter or a mark of one), to a word of its own, or to a space; bounded."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        found = c if c.isalpha() or unicodedata.category(c)[0] == "M" else " "
        if found != " " and any(a <= point <= b for a, b in UNSPACED):
            found = f" {c} "
        if len(self) > 50_000:
            self.clear()
        self[point] = found
        return found


LETTERS = Letters()


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, as UTF-8."""
    if text.isascii():
        return text.lower().encode().translate(BREAKS).split()
    return text.lower().translate(LETTERS).encode("utf-8", "replace").split()


def letters_of(words: list[bytes]) -> np.ndarray:
    """The number of letters of each word."""
    return np.fromiter((len(w) if w.isascii() else sum(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words), float, len(words))


def scripts_of(words: list[bytes]) -> np.ndarray:
    """The script of most letters of each word; -1 if none is known."""
    found = np.full(len(words), NAMES.index("latin"), np.int64)
    other = [k for k, w in enumerate(words) if not w.isascii()]
    if other:
        texts = [words[k].decode("utf-8", "replace") for k in other]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        at = np.searchsorted(STARTS, points, "right") - 1
        known = (at >= 0) & (points <= STOPS[np.maximum(at, 0)])
        of = np.repeat(np.arange(len(other)), [len(t) for t in texts])
        seen = np.bincount(of[known] * len(NAMES) + WHICH[at[known]], minlength=len(other) * len(NAMES)).reshape(-1, len(NAMES))
        found[other] = np.where(seen.any(1), seen.argmax(1), -1)
    return found


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (three bytes around each byte, five bytes, the word), with the number of their word."""
    joined = b"  " + b"  ".join(words) + b"  "
    data = np.frombuffer(joined, np.uint8).astype(np.int64)
    inner = np.flatnonzero(data != 32)
    three = (data[inner - 1] * 65536 + data[inner] * 256 + data[inner + 1]) * 0x9E3779B1
    five = three * 31 + (data[inner - 2] * 256 + data[inner + 2]) * 0x85EBCA6B + 1
    sizes = [len(w) for w in words]
    of = np.repeat(np.arange(len(words)), sizes)
    whole = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    buckets = np.concatenate([(three >> 12) % BUCKETS, (five >> 12) % BUCKETS, whole % BUCKETS])
    return buckets, np.concatenate([of, of, np.arange(len(words))])


class Known:
    """Words that a worker has scored: their rows in the tables of scores and letters; bounded by bytes."""

    def __init__(self, languages: int):
        self.languages, self.cache = languages, Cache()
        self.reset()

    def reset(self) -> None:
        self.scores, self.letters = np.zeros((0, self.languages), np.float32), np.zeros(0)

    def learn(self, words: set[bytes], model: LanguageModel) -> None:
        rows = self.cache.held
        new = list(words.difference(rows))
        if not new:
            return
        if self.cache.make_room(len(new), sum(map(len, new)) + len(new) * (4 * self.languages + 8)):
            self.reset()
            new = list(words)
        rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, *(model.word_scores(new[at : at + 50_000]) for at in range(0, len(new), 50_000))])
        self.letters = np.concatenate([self.letters, letters_of(new)])


class LanguageModel:
    """Log probabilities of the n-gram buckets by language, and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, least_script: float = 0.01):
        self.langs, self.name = langs, uuid.uuid4().hex
        total = counts.sum(1, keepdims=True)
        self.logs = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32) if langs else np.zeros((0, BUCKETS), np.float32)
        self.uses = scripts >= least_script * np.maximum(scripts.sum(1, keepdims=True), 1)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """A row of scores for each word; languages that don't use its script are out, if some language does."""
        buckets, of = grams(words)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(words)))
        scores = np.add.reduceat(self.logs[:, buckets[order]], starts, axis=1).T / 2
        which = scripts_of(words)
        allowed = np.where((which >= 0)[:, None], self.uses[:, which].T, True)
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, scores, scores.min() - 50).astype(np.float32)


def viterbi(index: np.ndarray, sizes: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path's language for every word of all texts at once.

    index: rows of ``scores`` for the words of the texts, one text after the other; sizes: words of each text, falling.
    """
    n, longest = len(sizes), int(sizes[0]) if len(sizes) else 0
    active = n - np.searchsorted(sizes[::-1], np.arange(longest), "right")  # texts that still have a word at each step
    offset = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = offset[step] + np.repeat(np.arange(n), sizes)
    turned = np.empty(len(index), np.int64)
    turned[place] = index
    switched = np.zeros((len(index), scores.shape[1]), bool)
    came = np.zeros(len(index), np.int16)
    value = np.zeros((n, scores.shape[1]), np.float32)
    for t in range(longest):
        a, lo, hi = active[t], offset[t], offset[t + 1]
        v = value[:a]
        if t:
            top = v.argmax(1)
            other = v[np.arange(a), top][:, None] - penalty
            switched[lo:hi] = v < other
            came[lo:hi] = top
            np.maximum(v, other, out=v)
            v -= other  # keeps the numbers small
        v += scores[turned[lo:hi]]
    path = np.empty(len(index), np.int16)
    for t in range(longest - 1, -1, -1):
        a, lo, hi = active[t], offset[t], offset[t + 1]
        more = active[t + 1] if t + 1 < longest else 0
        here = np.empty(a, np.int16)
        here[more:] = value[more:a].argmax(1)
        if more:
            nxt = path[offset[t + 1] : offset[t + 1] + more]
            jumped = switched[offset[t + 1] : offset[t + 1] + more][np.arange(more), nxt]
            here[:more] = np.where(jumped, came[offset[t + 1] : offset[t + 1] + more], nxt)
        path[lo:hi] = here
    return path[place]


def fit_languages(docs: DataFrame, usable: Column) -> LanguageModel:
    """Count n-grams and scripts by language over all rows for which ``usable`` and a lang hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        made: dict[str, np.ndarray] = {}
        size = 0

        def settle() -> None:
            for lang, counter in held.items():
                words = list(counter)
                if not words:
                    continue
                weights = np.fromiter(counter.values(), float, len(words))
                both = made.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                for at in range(0, len(words), 50_000):
                    part, w = words[at : at + 50_000], weights[at : at + 50_000]
                    buckets, of = grams(part)
                    both[:BUCKETS] += np.bincount(buckets, w[of], BUCKETS)
                    which = scripts_of(part)
                    both[BUCKETS:] += np.bincount(which[which >= 0], w[which >= 0], len(NAMES))
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                held.setdefault(lang.as_py(), Counter()).update(words)
                size += len(words)
                if size > 2_000_000:
                    settle()
                    size = 0
        settle()
        for lang, both in made.items():
            slot = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot, pa.int32()), pa.array(both[slot].astype(np.int64))], ["lang", "slot", "n"])

    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x (buckets + scripts) rows at most
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(NAMES)))
    table[np.searchsorted(np.array(langs, object), counted["lang"].to_numpy(object)) if langs else [], counted["slot"].to_numpy(int)] = counted["n"].to_numpy(float)
    return LanguageModel(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def identify(texts: list[str], model: LanguageModel, known: Known, penalty: float) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """The language number of every word of every text, and the words."""
    words = [words_of(t) for t in texts]
    known.learn(set(chain.from_iterable(words)), model)
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    index = np.fromiter(map(known.cache.held.__getitem__, chain.from_iterable(words[k] for k in order)), np.int64, int(sizes.sum()))
    path = viterbi(index, sizes[order], known.scores, penalty)
    cut = np.split(path, np.cumsum(sizes[order])[:-1])
    out: list = [None] * len(texts)
    for k, p in zip(order, cut, strict=True):
        out[k] = p
    return out, words


def language_spans(text: str, model: LanguageModel, penalty: float = 12.0) -> list[tuple[str, int, int]]:
    """(language, first word, end) of each run of words in one language."""
    if not text or not model.langs or not words_of(text):
        return []
    path = identify([text], model, Known(len(model.langs)), penalty)[0][0]
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(model.langs[path[a]], a, b) for a, b in zip(edges, edges[1:], strict=False)]


def predict_languages(docs: DataFrame, model: LanguageModel, penalty: float = 12.0, keep: list[str] | None = None, with_evidence: bool = False) -> DataFrame:
    """The ``keep`` columns (or all), lang_pred and score for every row; ``with_evidence`` also evidence.

    evidence: by how much, for each letter's byte, the best path's log probability is above that of unknown text, in which
    all n-gram buckets are equally likely. Other languages and scripts and random letters are below 0.5, mostly below 0.
    """
    extra = ["evidence"] if with_evidence else []
    kept = kept_columns(docs, keep, ["lang_pred", "score", *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        n_langs = len(model.langs)
        known = worker_cache(f"languages-{model.name}", lambda: Known(n_langs))

        def label(texts: list[str]) -> list[tuple[str, float, float]]:
            if not n_langs:
                return [("und", 0.0, 0.0)] * len(texts)
            paths, words = identify(texts, model, known, penalty)
            found = []
            for text, path, own in zip(texts, paths, words, strict=True):
                if not own or not any(map(str.isalpha, text)):
                    found.append(("und", 0.0, 0.0))
                    continue
                at = np.fromiter(map(known.cache.held.__getitem__, own), np.int64, len(own))
                letters = np.bincount(path, known.letters[at], n_langs)
                top, above = int(letters.argmax()), 0.0
                if with_evidence:
                    sizes = np.fromiter(map(len, own), float, len(own))
                    above = float((known.scores[at, path] + np.log(BUCKETS) * (2 * sizes + 1) / 2).sum() / sizes.sum())
                found.append((model.langs[top], float(letters[top] / letters.sum()), above))
            return found

        for batch in batches:
            texts, found, held = [], [], 0
            for text in batch.column(len(kept)):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > 6 << 20:
                    found += label(texts)
                    texts, held = [], 0
            found += label(texts) if texts else []
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            made += [pa.array([f[2] for f in found], pa.float64())] if with_evidence else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, "lang_pred", "score", *extra])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema_of(docs, kept, ", ".join(["lang_pred string, score double", *(f"{c} double" for c in extra)])))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict_languages(docs, fit_languages(docs, remainder("doc_id", 5) != 0), keep=["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
