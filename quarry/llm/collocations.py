"""Phrase collocations from vertical positional inverted lists.

Texts are gathered into blocks of one language, each stored as lists of the positions of its words. A frequent phrase's
occurrences in a block are merge-joined with the postings of the word behind it; the lengths of the lists, summed over
blocks, are exact frequencies, and what is frequent goes back to the blocks that hold it for the next length. Blocks and
hash buckets bound what a task holds, whatever the frequency of a word.

A null text counts as empty and a null language as ``und``; texts of any length count whole, repeated rows each.
Ties are ordered by the phrase's bytes. An empty table has no phrases. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions_for, shared_table

#: Bytes of text a block, and entries (different phrases of a block) that a task sums at once, on average.
BLOCK_BYTES, BUCKET_ENTRIES = 12 << 20, 1 << 20
#: A word's number: its first block and place there. Blocks have fewer than 2**24 different words as they have fewer bytes;
#: longer ones hold a single text and are refused.
PLACES = 24
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _letters() -> np.ndarray:
    """Bytes with A-Z lowered, ends of pieces as line feeds and tabs as spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(PIECE_ENDS)] = 10
    table[9] = 32
    return table


def packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as compressed planes of bytes."""
    planes = b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, size * columns * 8, codec="zstd"), np.uint8).reshape(columns, 8, size)
    return [np.ascontiguousarray(planes.T).view("<i8").ravel() for planes in raw]


def postings(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, their counts, and all positions by word. Neighbours in a piece are one apart, pieces at least two."""
    raw = _letters()[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    blank = (raw == 32) | (raw == 10)
    change = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = change[0::2], change[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
    positions = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=0) > 0)
    codes = words.indices.to_numpy()
    return words.dictionary.cast(pa.string()), np.bincount(codes, minlength=len(words.dictionary)), positions[np.argsort(codes, kind="stable")]


BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("positions", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang and text (binary) to blocks of one language."""
    first, made = TaskContext.get().partitionId() << 20, 0
    held: dict[str, tuple[list[bytes], int]] = {}

    def block(lang: str) -> pa.RecordBatch:
        nonlocal made
        words, counts, positions = postings(held.pop(lang)[0])
        if len(words) >= 1 << PLACES:
            raise ValueError("a text has too many different words for a block")
        starts = np.zeros(len(words), np.int64)
        np.cumsum(counts[:-1], out=starts[1:])
        gaps = np.diff(positions, prepend=0)
        gaps[starts] = positions[starts]
        row = [[first + made], [lang], [words], [counts.tolist()], [len(positions)], [packed([gaps])]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts, n = held.get(lang, ([], 0))
            if n and n + len(text) > BLOCK_BYTES:
                yield block(lang)
                texts, n = [], 0
            texts.append(text)
            held[lang] = (texts, n + len(text) + 1)
    for lang in list(held):
        if any(t.strip(b" \t" + PIECE_ENDS) for t in held[lang][0]):
            yield block(lang)


def matched(numbers: np.ndarray, at: np.ndarray, phrases: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the phrases (columns of word numbers, sorted rows) occur: indexes into ``at`` of their first words, and the phrase of each.

    ``numbers`` are the words at the ascending positions ``at``. Prefixes grow by a word: the list of a prefix is merged
    with the postings of the words one position on.
    """
    here = np.arange(len(at))
    found, place = np.zeros(len(at), np.int64), np.zeros(len(phrases[0]), np.int64)
    for k, column in enumerate(phrases):
        if k:
            there = np.searchsorted(at, at[here] + k)
            ok = (there < len(at)) & (at[np.minimum(there, len(at) - 1)] == at[here] + k)
            here, found, there = here[ok], found[ok], there[ok]
        else:
            there = here
        known, place = np.unique(place * base + column, return_inverse=True)
        asked = found * base + numbers[there]
        nth = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        ok = known[nth] == asked
        here, found = here[ok], nth[ok]
    back = np.zeros(len(known), np.int64)
    back[place] = np.arange(len(place))
    return here, back[found]


def bucket_of(columns: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


LISTS = "bucket long, block long, size long, payload binary"


def _extend(k: int, buckets: int):
    """Rows (block, size, positions, counts, known, phrases) to counts of the block's phrases of ``k`` words, by bucket.

    known: (place, number) of the block's frequent words; phrases: its frequent phrases of k - 1 words, if k is over 2.
    """

    def lists(block: int, size: int, data: bytes, counts: np.ndarray, known: tuple[bytes, int], kept: list[tuple[int, bytes]]):
        place, number = unpacked(known[0], known[1], 2)
        ends = np.cumsum(counts)
        gaps = unpacked(data, size, 1)[0]
        total = np.cumsum(gaps)
        at = total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), counts)  # positions within each list
        nth = np.full(len(counts), -1, np.int64)
        order = np.argsort(number)
        place, number = place[order], number[order]
        nth[place] = np.arange(len(place))
        word = np.repeat(nth, counts)
        at, word = at[word >= 0], word[word >= 0]
        by_place = np.argsort(at)
        at, word = at[by_place], word[by_place]
        base = len(number)
        if k == 2:
            shorter = [np.arange(base)]
            here, phrase = np.arange(len(at)), word
        else:
            columns = [np.concatenate(c) for c in zip(*(unpacked(d, n, k - 1) for n, d in kept), strict=True)]
            shorter = [np.searchsorted(number, c) for c in columns]
            here, phrase = matched(word, at, shorter, base)
        starts = at[here]  # ascending
        tail = np.searchsorted(starts, starts + 1)  # the phrase one on must be frequent too
        ok = (tail < len(starts)) & (starts[np.minimum(tail, len(starts) - 1)] == starts + 1)
        last = np.searchsorted(at, starts[ok] + k - 1)
        codes, n = np.unique(phrase[ok] * base + word[last], return_counts=True)
        out = [number[c[codes // base]] for c in shorter] + [number[codes % base]]
        home = bucket_of(out, buckets)
        order = np.lexsort([*reversed(out), home])
        columns = [c[order] for c in (*out, n)]
        cut = np.flatnonzero(np.diff(home[order], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            yield int(home[order[a]]), block, int(b - a), packed([c[a:b] for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                kept = [(p["size"], p["payload"]) for p in row.phrases] if k > 2 else []
                made = lists(row.block, row.size, row.positions, np.asarray(row.counts, np.int64), (row.known, row.words), kept)
                yield pd.DataFrame(made, columns=["bucket", "block", "size", "payload"])

    return run


def _frequent(k: int, least: int):
    """A bucket's lists to (block, size, payload): the frequent phrases with their sums under block -1, and each block's own."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(d, n, k + 1) for n, d in zip(frame["size"], frame["payload"], strict=True)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        owner = np.repeat(frame["block"].to_numpy(), frame["size"].to_numpy())
        order = np.lexsort([*reversed(columns[:k])])
        columns, owner = [c[order] for c in columns], owner[order]
        new = np.zeros(len(owner), bool)
        for c in columns[:k]:
            new |= np.diff(c, prepend=c[0] - 1) != 0
        first = np.flatnonzero(new)
        sums = np.add.reduceat(columns[k], first)
        ok = sums >= least
        rows = []
        if ok.any():
            rows.append((-1, int(ok.sum()), packed([*(c[first[ok]] for c in columns[:k]), sums[ok]])))
            kept = np.repeat(ok, np.diff(np.append(first, len(owner))))
            owner, columns = owner[kept], [c[kept] for c in columns[:k]]
            order = np.argsort(owner, kind="stable")
            cut = np.flatnonzero(np.diff(owner[order], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                rows.append((int(owner[order[a]]), int(b - a), packed([c[order[a:b]] for c in columns])))
        return pd.DataFrame(rows, columns=["block", "size", "payload"])

    return run


def _rows(k: int):
    """Payloads of phrases with their sums to a row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for n, d in zip(frame["size"], frame["payload"], strict=True):
                *ids, f = unpacked(d, n, k + 1)
                yield pd.DataFrame({"ids": list(np.stack(ids, axis=1)), "f": f})

    return run


def _known(place: pd.Series, number: pd.Series) -> bytes:
    return packed([place.to_numpy(), number.to_numpy()])


def frequent_phrases(docs: DataFrame, most_words: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases by length (ids array, f, and lang and phrase for single words), and words n by lang."""
    spark = docs.sparkSession
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kinds = "block long, lang string, words array<string>, counts array<long>, size long, positions binary"
    blocks = shared_table(given.mapInArrow(_blocks, kinds), "phrase-blocks")
    langs = blocks.groupBy("lang").agg(F.sum("size").alias("n"))
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions_for(docs), -(-total // BUCKET_ENTRIES))

    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "lang", "place", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("lang", "phrase")
    own = F.shiftleft("block", PLACES) + F.col("place")
    words = each.withColumn("own", own).withColumns({"f": F.sum("n").over(same), "id": F.min("own").over(same)}).filter(F.col("f") >= least)
    words = shared_table(words.select("block", "place", "lang", F.when(F.col("own") == F.col("id"), F.col("phrase")).alias("phrase"), "f", "id"), "phrase-words")
    levels = [words.filter("phrase IS NOT NULL").select(F.array("id").alias("ids"), "f", "lang", "phrase")]
    pack_known = F.pandas_udf(lambda places, ids: pd.Series([packed([np.asarray(p, np.int64), np.asarray(i, np.int64)]) for p, i in zip(places, ids, strict=True)]), "binary")
    # a block's frequent words and phrases: as many as a block can hold
    known = words.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("w")).select("block", F.size("w").cast("long").alias("words"), pack_known("w.place", "w.id").alias("known"))
    known = shared_table(known, "phrase-known")

    done: list[DataFrame] = []
    for k in range(2, most_words + 1):
        rows = blocks.select("block", "size", "positions", "counts").join(known, "block")
        if k > 2:
            own_phrases = done[-1].filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("size", "payload")).alias("phrases"))
            rows = rows.join(own_phrases, "block")
        counted = rows.mapInPandas(_extend(k, buckets), LISTS)
        done.append(shared_table(counted.groupBy("bucket").applyInPandas(_frequent(k, least), "block long, size long, payload binary"), f"phrases-{k}"))
        levels.append(shared_table(done[-1].filter("block < 0").mapInPandas(_rows(k), "ids array<long>, f long"), f"phrase-rows-{k}"))
    langs = shared_table(langs, "phrase-langs")
    forget(blocks, known, *done)
    return levels, langs


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact with 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``most_words`` words.

    a: occurrences of the phrase, at least ``least``; l, r: of the two parts at its lowest-scoring cut; n: words of the
    language. A phrase inside a longer candidate with ``covered`` percent of its occurrences is left out.
    """
    levels, langs = frequent_phrases(docs, most_words, least)
    known = [levels[0]]
    for k in range(2, most_words + 1):
        rows = levels[k - 1]
        for cut in range(1, k):
            parts = [known[n - 1].select(F.col("ids").alias(f"_{side}"), F.col("f").alias(f"{side}{cut}"), *([F.col("phrase").alias(f"{side}_text"), F.col("lang").alias(f"{side}_lang")] if cut == k - 1 else [])) for side, n in (("l", cut), ("r", k - cut))]
            rows = rows.join(parts[0], F.slice("ids", 1, cut) == F.col("_l")).join(parts[1], F.slice("ids", cut + 1, k - cut) == F.col("_r")).drop("_l", "_r")
        cuts = F.array(*(F.struct(score(F.col("f"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)))
        made = rows.select("ids", "f", F.col("l_lang").alias("lang"), F.concat("l_text", F.lit(" "), "r_text").alias("phrase"), F.array_min(cuts).alias("cut"))
        known.append(shared_table(made, f"collocations-{k}"))
    kept = None
    for k in range(2, most_words + 1):
        rows = known[k - 1]
        longer = None
        for m in range(k + 1, most_words + 1):
            inside = known[m - 1].select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(m - k + 1)), lambda i: F.slice("ids", i, k))).alias("ids"), F.col("f").alias("_longer"))  # noqa: B023
            longer = inside if longer is None else longer.union(inside)
        if longer is not None:
            most = longer.groupBy("ids").agg(F.max("_longer").alias("_longer"))
            rows = rows.join(most, "ids", "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("f") * covered)).drop("_longer")
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        kept = rows if kept is None else kept.union(rows)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(langs), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")  # a row a language


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the first 2000 phrases of every language in documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), every AS (
    SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM pieces WHERE len(w) > 0
), counts AS (
    SELECT lang, p, count(*) AS f FROM every GROUP BY ALL
), total AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE len(p) > 1 AND f >= 10
), cuts AS (
    SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.p, a, k, l.f AS l, r.f AS r, (1000000 * a::HUGEINT * a // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts c JOIN counts l ON c.lang = l.lang AND c.p[1:k] = l.p JOIN counts r ON c.lang = r.lang AND c.p[k + 1:] = r.p
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
    SELECT lang, unnest([p[1:2], p[2:3]]) AS p, f FROM candidates WHERE len(p) = 3
), free AS (
    SELECT s.* FROM lowest s LEFT JOIN (SELECT lang, p, max(f) AS f FROM inside GROUP BY ALL) i ON s.lang = i.lang AND s.p = i.p WHERE i.f IS NULL OR 100 * i.f < 50 * s.a
), named AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM free
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named JOIN total USING (lang) QUALIFY rank <= 2000
"""
