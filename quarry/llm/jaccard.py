"""Exact Jaccard join of word-shingle sets by a prefix tree.

Every shingle gets the exact number of sets that hold it: sets are cut into buckets of shingles, packed as arrays, and one
exchange brings each bucket's shingles together. A shingle that one set alone holds can't be shared, so a set is left with
its shared shingles, and it is done if those are too few for any link. Shared shingles have one global order, rare ones
first, and two sets of the wanted similarity share one within short prefixes of this order.

Sets that agree in a min-hash meet a leader first, which joins groups of near copies without comparing all their pairs.
After that only sets in different components that share a prefix shingle, at places that leave enough shingles, are
held against each other, all of them; so no link between components is lost, and a large group of near copies costs
little. All comparisons go through a prefix tree of globally ordered sets: one walk with a set's shingles finds all
that reach the similarity. Branches share the overlap counted so far, and a branch ends when what remains can't suffice.

Null texts, empty ones and those without words have empty sets, which link with nothing. Repeated rows are copies. Extra
columns are ignored. A null doc_id counts as the smallest number and is null in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, fewer_collections, forget, hot_join, partitions_for, shared_table, utf8, worker_cache
from .components import components

#: At most so many shingles that are frequent in single tasks are counted ahead; any bound gives the same links.
FREQUENT = 400_000
#: Sets of a stored block and of a block of probes, and entries of a shingle in a block.
PARTNERS, PROBES, BLOCK = 256, 64, 512
#: Odd numbers; each orders the shingles of a set anew, for its min-hash.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Shingles and texts of a packed chunk, and bits of a shingle's hash.
CHUNK, CHUNK_SETS, BITS = 4_000_000, 60_000, 48
NO_ID = -(1 << 63)


def shingles(raw: bytes, width: int, known: Cache | None = None) -> np.ndarray:
    """Sorted different hashes (of ``BITS`` bits) of the ``width``-word shingles of a text; of all its words, if they are fewer."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = Cache() if known is None else known
    held = known.held
    new = set(words).difference(held)
    if new and known.make_room(len(new), sum(map(len, new))):
        new = set(words)
    for w in new:
        held[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, 0x9E3779B97F4A7C15 + width, np.uint64)
    for k in range(width):
        out ^= h[k : len(words) - width + 1 + k]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out >> np.uint64(64 - BITS))


def known_words() -> Cache:
    return worker_cache("shingles", Cache)


def set_id(found: np.ndarray) -> int:
    """A number for a set of shingles (sorted by hash): 64 bits of its digest."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def read_sets(rows: DataFrame, width: int, least: int = 4) -> DataFrame:
    """Two kinds of rows: doc_id, digest, n, id (size and number of a text's set), and token, count of shingles frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        words, held, size, seen = known_words(), [], 0, set()

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= least
            n = int(often.sum())
            columns = [pa.nulls(n, pa.int64())] * 4 + [pa.array(values[often].view(np.int64)), pa.array(counts[often])]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "id", "token", "count"])

        for batch in batches:
            sizes, ids = [], []
            for raw in batch.column(1):
                found = shingles(raw.as_py(), width, words)
                sizes.append(len(found))
                ids.append(set_id(found))
                if ids[-1] not in seen:  # copies of a set count once
                    seen.add(ids[-1])
                    held.append(found)
                    size += len(found)
                if size > CHUNK:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), none, none], ["doc_id", "digest", "n", "id", "token", "count"])
        if held:
            yield counted()

    return rows.mapInArrow(run, "doc_id long, digest long, n long, id long, token long, count long")


def frequent(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the ``FREQUENT`` shingles with the highest counts by tasks."""
    got = made.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    hashes = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got["n"].to_numpy(np.int64)[order]


def prefix_size(n: int, percent: int) -> int:
    """First shingles of a set of n >= 1 among which it shares one with any set of at least the similarity."""
    return n - -(-percent * n // 100) + 1


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap with which sets of a and b shingles are similar: 100 o >= p (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def ordered_keys(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers that name shingles and have the global order: eighths of the count's binary logarithm, then the hash."""
    return np.minimum(8 * np.log2(counts), 255).astype(np.uint64) << np.uint64(BITS) | tokens


PACKED = "bucket int, chunk long, deltas binary, docs binary, keys binary, ids binary, sizes binary"
PARTS = "chunk long, docs binary, keys binary, ids binary, sizes binary"


def columns_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def pack_sets(rows: DataFrame, ranks, width: int, buckets: int) -> DataFrame:
    """The different sets of each task in chunks. Of a chunk: for each bucket of shingles their hashes (as differences) and
    the places of their sets in the chunk; the frequent shingles as keys with places; the sets' numbers and sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        words = known_words()
        hashes, often = ranks.value
        first = [(b << BITS) // buckets for b in range(buckets + 1)]
        found: list[np.ndarray] = []
        names: list[int] = []
        held, chunk = 0, TaskContext.get().partitionId() << 32
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat, of = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.uint16), sizes)
            rows = [(chunk % buckets, chunk, None, None, None, np.array(names, np.int64).tobytes(), sizes.astype("<u4").tobytes())]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                hot = hashes[at] == flat
                rows.append((chunk % buckets, chunk, None, of[hot].tobytes(), ordered_keys(flat[hot], often[at[hot]]).tobytes(), None, None))
                flat, of = flat[~hot], of[~hot]
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            edges = np.searchsorted(flat, np.array(first, np.uint64))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                part, docs = flat[edges[b] : edges[b + 1]], of[edges[b] : edges[b + 1]]
                deltas = np.diff(part, prepend=np.uint64(first[b]))
                rows.append((b, chunk, deltas.astype("<u4" if deltas.max() < 1 << 32 else "<u8").tobytes(), docs.tobytes(), None, None, None))
            return columns_of(rows, PACKED)

        for batch in batches:
            for raw in batch.column(0):
                one = shingles(raw.as_py(), width, words)
                name = set_id(one)
                if not len(one) or name in seen:
                    continue
                seen.add(name)
                found.append(one)
                names.append(name)
                held += len(one)
                if held > CHUNK or len(found) >= CHUNK_SETS:
                    yield out()
                    chunk += 1
                    found, names, held = [], [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if found:
            yield out()

    return rows.select("raw").mapInArrow(run, PACKED)


def shared_shingles(packed: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk its table of sets, and in parts the keys of its shared shingles with places. A task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        chunks: list[int] = []
        now = None

        def close() -> list[tuple]:
            if not tokens:
                return []
            token, of = np.concatenate(tokens), np.concatenate(docs)
            order = np.argsort(token, kind="stable")
            token, of = token[order], of[order]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(start, len(token)))
            count = np.repeat(count, count)
            token, of, count = token[count > 1], of[count > 1], count[count > 1]
            order = np.argsort(of, kind="stable")
            keys, of = ordered_keys(token, count)[order], of[order]
            edges = np.searchsorted(of, np.arange(len(chunks) + 1) << 16)
            out = [(c, (of[a:b] & 0xFFFF).astype("<u2").tobytes(), keys[a:b].tobytes(), None, None) for c, a, b in zip(chunks, edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
            for held in (tokens, docs, chunks):
                held.clear()
            return out

        for batch in batches:
            rows: list[tuple] = []
            for bucket, chunk, deltas, places, keys, ids, sizes in zip(*(batch.column(k) for k in range(7)), strict=True):
                if not deltas.is_valid:
                    rows.append((chunk.as_py(), places.as_py(), keys.as_py(), ids.as_py(), sizes.as_py()))
                    continue
                if bucket.as_py() != now:
                    rows += close()
                    now = bucket.as_py()
                index = np.frombuffer(places.as_buffer(), "<u2").astype(np.int64)
                raw = deltas.as_buffer()
                gaps = np.frombuffer(raw, "<u4" if raw.size == 4 * len(index) else "<u8").astype(np.uint64)
                tokens.append(np.cumsum(gaps, dtype=np.uint64) + np.uint64((now << BITS) // buckets))
                docs.append(index | len(chunks) << 16)
                chunks.append(chunk.as_py())
            yield columns_of(rows, PARTS)
        yield columns_of(close(), PARTS)

    dealt = packed.repartition(max(4 * buckets, partitions_for(packed)), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, PARTS)


def linkable_sets(parts: DataFrame, percent: int) -> DataFrame:
    """id, n, keys, central, min-hashes of the sets whose shared shingles are enough for some link.

    keys: the shared shingles in global order; central: how widely shared they are, which is most in the middle of a
    group of near copies. A task holds one chunk at a time. A set that several tasks read comes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        ids = sizes = np.empty(0, np.int64)
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, of = np.concatenate(keys), np.concatenate(docs)
            keys.clear()
            docs.clear()
            least = -(-percent * sizes // 100)
            enough = np.bincount(of, minlength=len(sizes)) >= least
            key, of = key[enough[of]], of[enough[of]]
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            edges = np.searchsorted(of, np.arange(len(sizes) + 1))
            rows: list[tuple] = []
            for k in np.flatnonzero(enough & (sizes > 0)).tolist():
                own = key[edges[k] : edges[k + 1]]
                central = int((own >> np.uint64(BITS)).sum()) * 1000 // int(sizes[k])
                rows.append((int(ids[k]), int(sizes[k]), own.tobytes(), central, *(int((own * np.uint64(mix)).min() >> np.uint64(1)) for mix in ORDERS)))
                if len(rows) == 2000:
                    yield columns_of(rows, schema)
                    rows = []
            yield columns_of(rows, schema)

        for batch in batches:
            for chunk, places, part, names, counts in zip(*(batch.column(k) for k in range(5)), strict=True):
                if chunk.as_py() != now:
                    yield from close()
                    now = chunk.as_py()
                if names.is_valid:
                    ids, sizes = np.frombuffer(names.as_py(), np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                else:
                    keys.append(np.frombuffer(part.as_py(), np.uint64))
                    docs.append(np.frombuffer(places.as_py(), "<u2").astype(np.int64))
        yield from close()

    schema = "id long, n long, keys binary, central long, " + ", ".join(f"low{k} long" for k in range(len(ORDERS)))
    dealt = parts.repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(run, schema).dropDuplicates(["id"])


class PrefixTree:
    """Globally ordered sets in a tree; an edge is a run of shingles in which no two sets below it part.

    Sets hold their shared shingles only; ``sizes`` are the whole sets' sizes.
    """

    def __init__(self, sets: list[np.ndarray], names: list[int], sizes: list[int], percent: int):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.percent = percent
        self.sets, self.names, self.sizes = [sets[k] for k in order], [names[k] for k in order], [sizes[k] for k in order]
        self.top = self.build(0, len(order), 0) if order else None

    def build(self, lo: int, hi: int, depth: int) -> tuple:
        """(edge, most shingles left below it, least size, ended sets, children) of the sets lo to hi - 1, which agree up to depth."""
        first, last = self.sets[lo], self.sets[hi - 1]
        m = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(apart[0]) if len(apart) else m
        at, ended = lo, []
        while at < hi and len(self.sets[at]) == end:
            ended.append(at)
            at += 1
        children = []
        while at < hi:
            label, stop = self.sets[at][end], at + 1
            low, high = at, hi  # the last set with this label, by binary search
            while low + 1 < high:
                middle = (low + high) // 2
                low, high = (middle, high) if self.sets[middle][end] == label else (low, middle)
            stop = low + 1
            children.append(self.build(at, stop, end))
            at = stop
        below = max((len(c[0]) + c[1] for c in children), default=0)
        return first[depth:end], below, min(self.sizes[lo:hi]), ended, children

    def search(self, probe: np.ndarray, size: int, first: bool = False) -> list[int]:
        """Names of the sets similar to ``probe`` (ordered keys) of a set of ``size``; of one of them, if ``first`` is set."""
        found: list[int] = []
        todo = [(self.top, 0)] if self.top else []
        n = len(probe)
        while todo:
            (edge, below, least, ended, children), overlap = todo.pop()
            wanted = needed(least, size, self.percent)
            past = 0
            if len(edge):
                past = int(probe.searchsorted(edge[0]))  # what of the probe comes before the edge is met or lost
                if overlap + min(len(edge) + below, n - past) < wanted:
                    continue
                at = probe.searchsorted(edge)
                overlap += int((probe[np.minimum(at, n - 1)] == edge).sum())
                past = int(probe.searchsorted(edge[-1], "right"))
            for k in ended:
                if overlap >= needed(self.sizes[k], size, self.percent):
                    found.append(self.names[k])
                    if first:
                        return found
            if children and overlap + min(below, n - past) >= wanted:
                todo += [(child, overlap) for child in children]
        return found


def similar_pairs(sides: DataFrame, sets: DataFrame, percent: int, joined: bool = False) -> DataFrame:
    """a, b of all similar sets on different sides of a group. sides (a shared table): g, id, probe (which side).

    joined: a group's stored sets are one component already, so one link of a probe to a block of them says all.

    Both sides of a group are cut into blocks, ``PARTNERS`` stored sets and ``PROBES`` probes at most on average, and each
    pair of blocks is one task's: a set's keys go once to each block of the other side, not once to each partner.
    """
    sizes = sides.groupBy("g").agg(F.sum(F.col("probe").cast("int")).alias("probed"), F.count("*").alias("all"))
    blocks = sizes.select("g", F.ceil(F.col("probed") / PROBES).cast("int").alias("probes"), F.ceil((F.col("all") - F.col("probed")) / PARTNERS).cast("int").alias("stores")).filter("probes > 0 AND stores > 0")
    other = F.when(F.col("probe"), F.col("stores")).otherwise(F.col("probes"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("stores"))).cast("int")
    spread = hot_join(sides, blocks, "g", "id").withColumn("own", own).withColumn("far", F.explode(F.sequence(F.lit(0), other - 1)))
    placed = spread.select("g", F.when(F.col("probe"), F.col("far")).otherwise(F.col("own")).alias("i"), F.when(F.col("probe"), F.col("own")).otherwise(F.col("far")).alias("j"), "probe", "id")
    placed = shared_table(placed.withColumn("cell", F.xxhash64("g", "i", "j")), "placed")
    rows = hot_join(placed, sets.select("id", "n", "keys"), "id", "cell").select("g", "i", "j", "probe", "id", "n", "keys").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewer_collections()
        now, probes, stored = None, {}, {}

        def close() -> list[tuple[int, int]]:
            if not probes or not stored:
                return []
            tree = PrefixTree([s[1] for s in stored.values()], list(stored), [s[0] for s in stored.values()], percent)
            return [(a, b) for a, (size, keys) in probes.items() for b in tree.search(keys, size, joined) if a != b]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for g, i, j, probe, name, n, keys in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if now != (g, i, j):
                    out += close()
                    now, probes, stored = (g, i, j), {}, {}
                (probes if probe else stored)[name] = (n, np.frombuffer(keys, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def led_sides(sets: DataFrame) -> DataFrame:
    """g, id, probe: each set beside the leader of its min-hash in each order, the most central set; it is the group's probe."""
    lows = sets.select("id", "central", F.posexplode(F.array(*(F.col(f"low{k}") for k in range(len(ORDERS))))).alias("k", "low"))
    lows = shared_table(lows.select("id", "central", F.xxhash64("k", "low").alias("low")), "lows")
    leaders = lows.groupBy("low").agg(F.max(F.struct("central", "id"))["id"].alias("g"), F.count("*").alias("n")).filter("n > 1").select("low", "g")
    led = hot_join(lows, leaders, "low", "id").select("g", "id").filter("g != id").distinct()
    led = shared_table(led.select("g", "id", F.lit(False).alias("probe")), "led")
    out = shared_table(led.union(led.select("g", F.col("g").alias("id"), F.lit(True).alias("probe")).distinct()), "sides")
    forget(lows)
    return out


def open_sides(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """g, id, probe: sets that may be similar though in different components, by the larger component of two.

    Sets meet at prefix shingles that several components hold. A shingle's entries are cut into blocks: components of many
    entries have blocks of their own, which don't meet each other; each pair of blocks is one task's. A pair counts if
    sizes and places leave enough shingles. A group holds sets of its component (stored) and the outer sets (probes).
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for name, n, keys, component, weight in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(keys, np.uint64)
                missing = n - len(own)  # shingles of its own come first
                own = own[: max(0, prefix_size(n, percent) - missing)]
                for column, value in zip(columns, (own.view(np.int64), np.full(len(own), name), np.full(len(own), n), np.arange(missing, missing + len(own)), np.stack([np.full(len(own), component), np.full(len(own), weight)])), strict=True):
                    column.append(value)
            if not columns[0]:
                continue
            both = np.concatenate(columns[4], 1)
            flat = [*(np.concatenate(c) for c in columns[:4]), both[0], both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], ["token", "id", "n", "place", "component", "weight"])

    known = shared_table(labelled(sets.select("id", "n", "keys"), labels), "labelled")
    schema = "token long, id long, n long, place long, component long, weight long"
    entries = shared_table(known.mapInArrow(prefixes, schema), "prefixes")
    own = entries.groupBy("token", "component").agg(F.count("*").alias("m"))
    mixed = own.groupBy("token").agg(F.count("*").alias("different"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))).alias("small")).filter("different > 1")
    mixed = shared_table(mixed.select("token", F.ceil(F.coalesce("small", F.lit(0)) / BLOCK).cast("int").alias("small")), "mixed")
    # Blocks of large components follow those of the others; there is one row a large component of a shingle.
    large = own.filter(F.col("m") > BLOCK).join(mixed, "token").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))).alias("large"))
    blocks = mixed.join(large, "token", "left").withColumn("large", F.coalesce("large", F.array().cast("array<struct<component:bigint,blocks:int>>")))
    left = hot_join(entries, blocks, "token", "id")
    before = F.filter("large", lambda x: x["component"] < F.col("component"))
    mine = F.filter("large", lambda x: x["component"] == F.col("component"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["blocks"])
    left = left.withColumns({"first": F.col("small") + total(before), "pure": total(mine), "every": F.col("small") + total(F.col("large"))})
    place = F.when(F.col("pure") > 0, F.col("first") + F.pmod(F.xxhash64("id"), F.col("pure"))).otherwise(F.pmod(F.xxhash64("component"), F.greatest("small", F.lit(1)))).cast("int")
    far = F.filter(F.sequence(F.lit(0), F.col("every") - 1), lambda k: (F.col("pure") == 0) | (k < F.col("first")) | (k >= F.col("first") + F.col("pure")))
    cells = left.withColumn("own", place).withColumn("far", F.explode(far)).withColumns({"i": F.least("own", "far"), "j": F.greatest("own", "far")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, sent = [], set()
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(9)])
            keys = table[:3]
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), table.shape[1]]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                here = tuple(keys[:, lo].tolist())
                if here != now and carried:
                    yield from paired(np.concatenate(carried, 1), sent)
                    carried = []
                now = here
                carried.append(table[:, lo:hi])
        if carried:
            yield from paired(np.concatenate(carried, 1), sent)

    def paired(cell: np.ndarray, sent: set) -> Iterator[pa.RecordBatch]:
        _, i, j, own, ids, n, place, component, weight = cell
        one = np.flatnonzero(own == i[0])
        two = one if i[0] == j[0] else np.flatnonzero(own == j[0])
        rows: set[tuple] = set()
        for at in range(0, len(one), 256):
            p, q = (m.ravel() for m in np.meshgrid(one[at : at + 256], two, indexing="ij"))
            different = (component[p] != component[q]) & (p < q if i[0] == j[0] else True)
            p, q = p[different], q[different]
            alpha = -(-percent * (n[p] + n[q]) // (100 + percent))
            # Two similar sets share a shingle of both prefixes that their own sizes allow, and leave enough after it.
            keep = (place[p] <= n[p] - alpha) & (place[q] <= n[q] - alpha) & (np.minimum(n[p], n[q]) >= alpha)
            p, q = p[keep], q[keep]
            swap = (weight[p] > weight[q]) | (weight[p] == weight[q]) & (component[p] < component[q])
            p, q = np.where(swap, q, p), np.where(swap, p, q)  # q is in the component that names the group
            rows.update(zip(component[q].tolist(), ids[p].tolist(), [True] * len(p), strict=True))
            rows.update(zip(component[q].tolist(), ids[q].tolist(), [False] * len(p), strict=True))
        rows -= sent
        if len(sent) > 200_000:
            sent.clear()
        sent |= rows
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["g", "id", "probe"])

    dealt = cells.select("token", "i", "j", "own", "id", "n", "place", "component", "weight").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    out = shared_table(dealt.mapInArrow(run, "g long, id long, probe boolean").distinct(), "sides")
    forget(known, entries, mixed)
    return out


def labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets with component and weight (sets of the component); a set without a link is a component of its own."""
    sized = hot_join(labels, labels.groupBy("component").agg(F.count("*").alias("weight")), "component", "id")
    return sets.join(sized, "id", "left").withColumns({"component": F.coalesce("component", "id"), "weight": F.coalesce("weight", F.lit(1).cast("long"))})


def buckets_for(entries: int) -> int:
    """Buckets of a million shingles; of more, but twenty millions at most, beyond 65,536 of them."""
    return max(1, min(-(-entries // 1_000_000), 1 << 16), -(-entries // 20_000_000))


def digest(column: str = "text") -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(utf8(column))


def link_classes(docs: DataFrame, width: int = 5, percent: int = 75, with_class: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``with_class`` also digest (of the text) and class_id.

    class_id tells components apart even where a doc_id has several texts; it is null for empty sets.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8().alias("raw"), digest().alias("digest"))
    made = shared_table(read_sets(rows, width), "read")
    ranks = docs.sparkSession.sparkContext.broadcast(frequent(made))
    members = shared_table(made.filter("n > 0").select("doc_id", "digest", "n", "id"), "members")
    empty = shared_table(made.filter("n = 0").select("doc_id", "digest", "n"), "members")
    forget(made)
    buckets = buckets_for(members.agg(F.sum("n")).first()[0] or 0)
    sets = shared_table(linkable_sets(shared_shingles(pack_sets(rows, ranks, width, buckets), buckets), percent), "sets")
    ranks.destroy()
    led = led_sides(sets)
    links = shared_table(similar_pairs(led, sets, percent), "links")
    labels = components(links)
    sides = open_sides(sets, labels, percent)
    more = shared_table(similar_pairs(sides, sets, percent, True), "links")
    final = labels if more.isEmpty() else components(links.unionByName(more))
    forget(led, sides, sets)
    copies = members.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = shared_table(copies.join(final, "id", "left").filter("copies > 1 OR component IS NOT NULL").select("id", "least", F.coalesce("component", "id").alias("component")), "classes")
    named = hot_join(classes, classes.groupBy("component").agg(F.min("least").alias("smallest")), "component", "id").select("id", "smallest", F.col("component").alias("class_id"))
    linked = hot_join(members, named, "id", "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "id")).drop("id")
    none = F.lit(None).cast("long")
    out = linked.unionByName(empty.withColumns({"smallest": none, "class_id": none}))
    real = lambda c: F.when(c > NO_ID, c)
    more_columns = ["digest", "class_id"] if with_class else []
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("smallest", "doc_id")).alias("component_id"), *more_columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: shingle-set size and component of every document."""
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
