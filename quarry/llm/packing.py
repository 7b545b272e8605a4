"""Best-fit packing of tokenised documents by bin completion.

``token_pieces`` cuts documents into pieces of at most ``limit`` tokens; ``pack_pieces`` puts the pieces into as few
sequences as it can. Only the counts of the (at most ``limit``) different lengths reach the driver, where the plan is
found by branch and bound; ranks within a length then tell every piece its place, without any group in one task.

Null and empty texts become one piece with the end token. Equal rows are packed separately. Empty input gives no rows.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fewer_collections, shared_table, worker_cache

#: Where this finds nothing, spaces and line breaks stand alone between other characters, and each ends a pre-token.
RUNS = re.compile(r"\s\s|\A\s|\s\Z")
#: Found in parts (for Arrow) with other characters than these, which the tokenizer's and the rank file's patterns read alike.
NOT_PLAIN = r"[^\n -~\x{a1}-\x{24f}]"
#: Found in all texts in which ``RUNS`` is, and in some others.
PERHAPS_RUNS = NOT_PLAIN + r"|[ \n][ \n]|\A[ \n]|[ \n]\z"


class Encoder:
    """Ids of whole texts as bytes (little-endian unsigned 32-bit).

    Texts are joined by line breaks and cut into parts before each space and line break. New parts of a batch are encoded
    together in one run of the rank file, which holds the same vocabulary; parts that aren't plain and texts with runs of
    white space go through the tokenizer itself. Parts are kept for the next batches up to ``budget`` bytes, and beyond it
    those of the last batch only.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None, budget: int = 16 << 20):
        self.tokenizer = load_tokenizer(path)
        self.specials = special_strings(self.tokenizer)
        self.budget = budget
        self.parts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.ranks = None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, k in ranks.items():
                self.bytes_of[k] = len(token)

    def slow(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fast(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Encodings of plain parts."""
        if not len(parts):
            return pa.array([], pa.large_binary())
        ends = offsets(parts)
        ids = self.ranks.encode_to_numpy(parts.buffers()[2][ends[0] : ends[-1]].to_pybytes().decode()).astype("<u4")
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[1:] - ends[0]) + 1
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(4 * np.append(0, cuts)), pa.py_buffer(ids.tobytes())])

    def learn(self, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Encodings of different parts, each from its space or line break on."""
        known = pc.index_in(parts, self.parts)
        new = parts.filter(known.is_null())
        plain = pc.invert(pc.match_substring_regex(new, NOT_PLAIN)) if self.ranks else pa.array(np.zeros(len(new), bool))
        quick, other = new.filter(plain), new.filter(pc.invert(plain))
        slow = pa.array([self.slow(x) for x in other.to_pylist()], pa.large_binary())
        at, first = np.asarray(known.fill_null(-1)).astype(np.int64), np.asarray(plain)
        at[at < 0] = len(self.parts) - 1 + np.where(first, np.cumsum(first), len(quick) + np.cumsum(~first))
        held = pa.concat_arrays([self.parts, quick, other])
        ids = pa.concat_arrays([self.ids, self.fast(quick), slow])
        found = ids.take(pa.array(at))
        small = held.nbytes + ids.nbytes <= self.budget
        self.parts, self.ids = (held, ids) if small else (parts, found)
        return found

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without runs of white space, by their different parts."""
        raw = ("\n" + "\n".join(texts)).encode()
        data = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((data == ord(" ")) | (data == ord("\n")))
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        ids = self.learn(parts.dictionary).take(parts.indices)
        sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        at = offsets(ids)[np.searchsorted(starts, np.append(0, np.cumsum(sizes)))].tolist()
        before = len(self.slow("\n"))  # of the line break that joins
        return [ids.buffers()[2][a + before : b].to_pybytes() for a, b in pairwise(at)]

    def encode(self, texts: list[str]) -> list[bytes]:
        perhaps = pc.match_substring_regex(pa.array(texts, pa.large_string()), PERHAPS_RUNS).to_pylist()
        odd = [look and RUNS.search(text) or any(s in text for s in self.specials) for look, text in zip(perhaps, texts, strict=True)]
        rest = iter(self.together([text for text, o in zip(texts, odd, strict=True) if text and not o]))
        return [(self.slow(text) if o else next(rest)) if text else b"" for text, o in zip(texts, odd, strict=True)]


def offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a large string or binary array begins in the buffer, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)


def encoder(path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    """One encoder a worker, kept from task to task."""
    return worker_cache(f"packing {path} {ranks_path} {pattern}", lambda: Encoder(path, ranks_path, pattern))


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): all tokens of every text, in pieces.

    A document of n tokens (its end token counted) over ``limit`` has a first piece of n mod ``limit`` tokens, if that
    isn't zero, and then full ones; a shorter document is one piece. ``ranks_path`` may name the same vocabulary as a
    rank file, with its ``pattern``, for speed; the ids are the tokenizer's either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, ranks_path, pattern)
        fewer_collections()
        end = np.asarray([end_id], "<u4").tobytes()

        def cut(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(doc_ids, own.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                at = [0, *range(n % limit or limit, n, limit)]
                for k, a in enumerate(at):
                    b = at[k + 1] if k + 1 < len(at) else n
                    for column, value in zip(out, (doc_id, k, a, b - a, ids[4 * a : 4 * b]), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > 4 << 20:
                    yield cut(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
            yield cut(doc_ids, texts)

    names = ["doc_id", "piece", "start", "length", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


#: Lengths that are looked at in the time of one step of an enumeration, about.
COST = 64
#: Parts into which the shares of the bin that a bound counts are divided, at most.
PARTS = 12


def waste_bound(counts: dict[int, int], limit: int) -> int:
    """Least number of bins: the best of bounds by certain waste.

    Room that no multiple of the lengths' common divisor reaches is wasted in every bin. Large items need bins of their
    own (L2), and if n + 1 items of a length don't fit, each takes an n-th of a bin (dual feasible functions).
    """
    k = np.array(sorted(counts), np.int64)
    v = np.array([counts[x] for x in k.tolist()], np.int64)
    if not len(k):
        return 0
    limit -= limit % math.gcd(*k.tolist())
    items, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (v, k * v))
    half = int(np.searchsorted(k, limit // 2, "right"))
    floors = np.concatenate([[0], k[:half]])
    top = np.maximum(np.searchsorted(k, limit - floors, "right"), half)  # items from here on leave no room for the floor
    huge = items[-1] - items[top]
    large = items[top] - items[half]
    room = large * limit - (sums[top] - sums[half])
    small = sums[half] - sums[np.searchsorted(k, floors)]
    more = np.maximum(0, -(-(small - room) // limit))
    n = np.arange(1, PARTS)[:, None]
    parts, exact = (n + 1) * k // limit, (n + 1) * k % limit == 0
    shares = ((np.where(exact, 0, parts) * v).sum(1) * limit + (np.where(exact, k, 0) * v).sum(1) * n[:, 0], limit * n[:, 0])
    return int(max((huge + large + more).max(), (-(-shares[0] // shares[1])).max()))


class Steps:
    """What a search may still do."""

    def __init__(self, left: int):
        self.left = left

    def spend(self, n: int = 1) -> bool:
        self.left -= n
        return self.left >= 0


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counted lengths: (times, filling) pairs; the incumbent of the search."""
    left = dict(counts)
    keys = sorted(k for k, v in left.items() if v)
    plan = []
    while keys:
        room, filling = limit, []
        while room > 0 and keys:
            at = bisect_right(keys, room) - 1
            while at >= 0 and left[keys[at]] <= filling.count(keys[at]):
                at -= 1
            if at < 0:
                break
            filling.append(keys[at])
            room -= keys[at]
        times = min(left[k] // filling.count(k) for k in set(filling))
        plan.append((times, filling))
        for k in set(filling):
            left[k] -= times * filling.count(k)
        keys = [k for k in keys if left[k]]
    return plan


def fillings(left: dict[int, int], keys: list[int], room: int, steps: Steps | None = None) -> Iterator[tuple[int, list[int]]]:
    """All undominated fillings of ``room`` with the remaining lengths, as (waste, lengths), least waste first.

    A filling is dominated if some of its lengths, none perhaps, can give way to one length left out that is at least their
    sum and still fits: whatever a plan does with the one, it can do with the others. Fillings of one sum are enumerated
    along the sums that can be reached, large lengths first, and given up as soon as the lengths decided on are dominated.
    The enumeration ends where ``steps`` do.
    """
    steps = steps or Steps(1 << 60)
    keys = [k for k in keys if k <= room]
    if not steps.spend(len(keys) // COST):
        return
    full = (1 << (room + 1)) - 1
    reach = [1]  # sums of the first k lengths, as bits
    for k in keys:
        sums, times, step = reach[-1], min(left[k], room // k), 1
        while times > 0:
            n = min(step, times)
            sums |= sums << (n * k) & full
            times, step = times - n, 2 * step
        reach.append(sums)

    def within(sums: int, waste: int) -> int:
        """Bits from each sum to ``waste`` above it."""
        done = 0
        while done < waste:
            step = min(done + 1, waste - done)
            sums |= sums << step
            done += step
        return sums

    def exact(total: int, at: int, waste: int, sums: int, skipped: int) -> Iterator[list[int]]:
        """Fillings of a sum with the first ``at`` lengths; sums: of the lengths taken; skipped: lengths left out."""
        if total == 0:
            low = keys[:at]
            if not any(k <= waste for k in low[:1]):  # one that fits beside
                yield []
            return
        while at and not keys[at - 1] <= total:
            at -= 1
            skipped |= 1 << keys[at]
        if not at or not reach[at] >> total & 1 or within(sums, waste) & skipped:
            return
        k = keys[at - 1]
        for n in range(min(left[k], total // k), -1, -1):
            if reach[at - 1] >> (total - n * k) & 1:
                if not steps.spend():
                    return
                more, out = sums, skipped if n else skipped | 1 << k
                for _ in range(n):
                    more |= more << k
                if within(more, waste) & out:
                    continue
                for rest in exact(total - n * k, at - 1, waste, more, out):
                    yield [k] * n + rest

    for total in range(room, -1, -1):
        if reach[-1] >> total & 1:
            for filling in exact(total, len(keys), room - total, 1, 0):
                if not dominated(filling, left, keys, room - total):
                    yield room - total, filling
        if steps.left < 0:
            return


def dominated(filling: list[int], left: dict[int, int], keys: list[int], waste: int) -> bool:
    """Whether a length left out may take the place of some of the filling's, with as large a sum or more."""
    sums = 1
    for k in filling:
        sums |= sums << k
    window = (1 << (waste + 1)) - 1
    for x in keys:
        if left[x] <= filling.count(x):
            continue
        own = sums
        if x in filling:  # x itself changes nothing, so it isn't one of those that give way
            own = 1
            for k in filling:
                if k != x:
                    own |= own << k
        low = max(0, x - waste)
        if own >> low & window >> (waste - (x - low)):
            return True
    return False


#: Different lengths of a state that the search remembers; it only saves repeated work.
KEPT_STATE = 64


def complete_bins(counts: dict[int, int], limit: int, nodes: int = 20_000, work: int = 200_000) -> list[tuple[int, list[int]]]:
    """Bin completion: fill the bin of the largest remaining item in each undominated way, least waste first, and back up.

    A branch ends when its waste, or its bins and the bound of what remains, pass what a plan better than the incumbent
    could have, or when the same lengths were left before after as few bins. One decision covers as many bins as it can;
    on backing up half as many are tried, and so on to one, so every plan is in the search. ``nodes`` bounds the
    decisions and ``work`` the steps between them; at the end of either the incumbent stands.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return []
    incumbent = best_fit(counts, limit)
    least = waste_bound(counts, limit)
    total = sum(k * v for k, v in counts.items())
    size = sum(t for t, _ in incumbent)
    if size == least:
        return incumbent
    left, plan, steps = dict(counts), [], Steps(work)
    waste = used = seen = 0
    before: dict[tuple, int] = {}

    def ways() -> Iterator[tuple[int, int, list[int]]]:
        """(waste, times, filling) of all decisions for the largest item."""
        keys = sorted(k for k, v in left.items() if v)
        top = keys[-1]
        left[top] -= 1
        usable = {k: v for k, v in left.items() if v}
        left[top] += 1
        for w, rest in fillings(usable, sorted(usable), limit - top, steps):
            filling = [top, *rest]
            times = min(left[k] // filling.count(k) for k in set(filling))
            while times:
                yield w, times, filling
                times //= 2

    def apply(w: int, times: int, filling: list[int], sign: int) -> None:
        nonlocal waste, used
        for k in filling:
            left[k] -= sign * times
        waste += sign * w * times
        used += sign * times

    trail = [ways()]
    while trail and seen < nodes and size > least and steps.left >= 0:
        allowed = (size - 1) * limit - total
        step = next(trail[-1], None)
        if step is None or waste + step[0] > allowed:  # wastes only grow
            trail.pop()
            if plan:
                times, filling = plan.pop()
                apply(limit - sum(filling), times, filling, -1)
            continue
        w, times, filling = step
        if waste + w * times > allowed:
            continue
        seen += 1
        steps.spend(len(left) // COST)
        apply(w, times, filling, 1)
        state = tuple(sorted((k, v) for k, v in left.items() if v))
        hopeless = state and (before.get(state, used + 1) <= used or used + waste_bound(dict(state), limit) >= size)
        if not state and used < size:
            incumbent, size = [*plan, (times, filling)], used
        if not state or hopeless:
            apply(w, times, filling, -1)
            continue
        if len(state) <= KEPT_STATE:
            before[state] = used
        plan.append((times, filling))
        trail.append(ways())
    return incumbent


def placements(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, copies in a sequence), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for k in sorted(set(filling), reverse=True):
            copies = filling.count(k)
            rows.append((k, rank.get(k, 0), sequence, offset, copies))
            rank[k] = rank.get(k, 0) + times * copies
            offset += k * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, limit: int = 1024, nodes: int = 20_000, rows_in_task: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` from 1 to ``limit``; any other columns stay."""
    pieces = shared_table(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    where = placements(complete_bins(counts, limit, nodes))
    # Ranks within a length: in salted groups of bounded size, each shifted by the rows of the groups before it.
    salts = max(1, -(-max(counts.values(), default=1) // rows_in_task)) * 8
    key = [F.col("doc_id"), F.col("piece")]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*key))
    ranked = salted.withColumn("_own", own).join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before") - 1)
    names = pieces.columns
    spread = 1 << 44
    starts = where[:, 0] * spread + where[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("length", "_rank"))
            at = where[np.searchsorted(starts, length * spread + rank, "right") - 1]
            nth = rank - at[:, 1]
            more = [at[:, 2] + nth // at[:, 4], at[:, 3] + nth % at[:, 4] * length]
            kept = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in more)], [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(place, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every piece of every document with its sequence and offset."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
