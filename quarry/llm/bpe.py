"""BPE encoding by a streaming transducer with bounded lookahead, and decoding by an incremental state machine.

``sufficient_lookahead`` derives from the merge list how many symbols after a token can still change it. ``WordStream``
takes the symbols of words window by window and emits a token once that many symbols follow it (or the word ends), so its
memory doesn't depend on a word's length. ``StreamDecoder`` turns the ids of a text into text piece by piece. All words
and all ids go through these two; a bounded cache keeps what the transducer gave for a word.

Null texts count as empty and give no tokens. Texts of any length, ties and repeated rows need no special care. Extra
columns are ignored. Empty input gives no rows.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, fewer_collections, worker_cache

NEVER = 1 << 60
#: Python counts these as white space, the word pattern does not.
INFORMATION = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


BYTE_OF = {c: b for b, c in enumerate(byte_symbols())}


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """A number of symbols such that what lies further right of a token's end can't change the token.

    Where two texts part, their tokens agree up to a frontier. A rule (a, b) moves it left by a's symbols, if b starts at
    the frontier: with the left part of an earlier rule, whose own merge differs. Chains of such rules in the order of the
    list bound the way of the frontier; the longest right part is added for the token that the chain starts from.
    """

    def symbols(token: str) -> int:
        return len(token) - len(suffix) + 1 if suffix and token.endswith(suffix) else len(token)

    reach: dict[str, int] = {}
    most = longest = 0
    for a, b in merges:
        before = max((reach.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        now = symbols(a) + before
        reach[a] = max(reach.get(a, 0), now)
        most, longest = max(most, now), max(longest, symbols(a) + symbols(b))
    return most + longest


class Merges:
    """Ranks of the pairs of token ids, the ids that they merge into, and the number of symbols of each token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.size = {k: len(t) - len(suffix) + 1 if suffix and t.endswith(suffix) else len(t) for t, k in vocab.items()}
        self.lookahead = sufficient_lookahead(merges, suffix)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.sorted_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.sorted_ranks = np.append(np.fromiter(self.ranks.values(), np.int64, len(keys))[order], NEVER)
        self.made_array = np.array(self.made, np.int64)

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges, the lowest rank first and the leftmost of equals."""
        get, made, s = self.ranks.get, self.made, list(symbols)
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(s, s[1:], strict=False)]
        while ranks and (low := min(ranks)) < NEVER:
            k = ranks.index(low)
            s[k] = now = made[low]
            del s[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(now << 32 | s[k + 1], NEVER)
            if k:
                ranks[k - 1] = get(s[k - 1] << 32 | now, NEVER)
        return s


    def apply_all(self, words: list[list[int]]) -> list[list[int]]:
        """``apply`` for many short words at once, one merge of each word a round."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=1))
        cells = np.full((len(words), width + 1), -1, np.int64)
        cells[np.arange(width + 1) < sizes[:, None]] = np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum()))
        ranks = self.lookup(cells[:, :-1], cells[:, 1:])
        live, columns = np.arange(len(words)), np.arange(width + 1)
        while len(live):
            low = ranks[live].min(1)
            live, low = live[low < NEVER], low[low < NEVER]
            if not len(live):
                break
            k = ranks[live].argmin(1)
            shift = columns + (columns > k[:, None])
            row, n = cells[live], np.arange(len(live))
            row = np.take_along_axis(np.concatenate([row, np.full((len(live), 1), -1)], 1), shift, 1)
            row[n, k] = self.made_array[low]
            rank = np.concatenate([ranks[live], np.full((len(live), 1), NEVER)], 1)
            rank = np.take_along_axis(rank, (columns + (columns >= k[:, None]))[:, :width], 1)
            rank[n, k] = self.lookup(row[n, k], row[n, k + 1])
            has = np.flatnonzero(k > 0)
            rank[has, k[has] - 1] = self.lookup(row[has, k[has] - 1], row[has, k[has]])
            cells[live], ranks[live] = row, rank
        return [c[: c.index(-1)] for c in cells.tolist()]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where(b < 0, -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], NEVER)


class WordStream:
    """The transducer of a word's symbols to tokens; keeps at most twice the lookahead and some symbols.

    A token is emitted once it ends so far before the last symbol seen that no later one can change it.
    """

    def __init__(self, merges: Merges, slack: int = 256):
        self.merges, self.room, self.held = merges, 2 * merges.lookahead + slack, []

    def stable(self, tokens: list[int], seen: int) -> tuple[list[int], int]:
        """The first of a window's tokens that are stable, and the symbols they have; seen: symbols of the window."""
        last, end = seen - self.merges.lookahead, 0
        for k, token in enumerate(tokens):
            if end + self.merges.size[token] > last:
                return tokens[:k], end
            end += self.merges.size[token]
        return tokens, end

    def feed(self, symbols: list[int]) -> Iterator[int]:
        for at in range(0, len(symbols), self.room):
            self.held += symbols[at : at + self.room]
            if len(self.held) > self.room:
                tokens, end = self.stable(self.merges.apply(self.held), len(self.held))
                yield from tokens
                del self.held[:end]

    def finish(self) -> list[int]:
        """The rest of the word; all of a word no longer than the window."""
        rest, self.held = self.merges.apply(self.held), []
        return rest

    def many(self, words: list[list[int]]) -> list[list[int]]:
        """Tokens of many words, each with a window of its own; a round merges the windows of all words together."""
        out: list[list[int]] = [[] for _ in words]
        held: list[list[int]] = [[] for _ in words]
        read = [0] * len(words)
        live = sorted(range(len(words)), key=lambda k: len(words[k]))
        while live:
            more = []
            for at in range(0, len(live), 10_000):
                part = live[at : at + 10_000]
                windows = [held[k] + words[k][read[k] : read[k] + self.room] for k in part]
                for k, window, tokens in zip(part, windows, self.merges.apply_all(windows), strict=True):
                    read[k] += self.room
                    if read[k] >= len(words[k]):
                        out[k] += tokens
                        continue
                    tokens, end = self.stable(tokens, len(window))
                    out[k] += tokens
                    held[k] = window[end:]
                    more.append(k)
            live = more
        return out


class StreamDecoder:
    """Ids to text. pieces: what each id adds; with a space before it, if the file has no decoder (byte_level is false).

    Bytes that aren't UTF-8 become U+FFFD; the bytes of an unfinished character are kept until the next id.
    """

    def __init__(self, pieces: dict[int, bytes], byte_level: bool):
        self.pieces, self.byte_level, self.started = pieces, byte_level, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids))
        if raw and not self.started:
            self.started = True
            raw = raw if self.byte_level else raw[1:]
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decoder_pieces(tokens: dict[int, str], byte_level: bool) -> dict[int, bytes]:
    """What each id adds to a text."""
    if byte_level:
        return {k: bytes(BYTE_OF[c] for c in t) if all(c in BYTE_OF for c in t) else t.encode() for k, t in tokens.items()}
    return {k: b" " + t.encode() for k, t in tokens.items()}


class WordTokenizer:
    """The tokenizer file's normaliser, word pattern and merges, over whole texts, with a bounded cache of words."""

    def __init__(self, path: str):
        held = json.load(open(path, encoding="utf-8"))
        model = held["model"]
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        steps = held["normalizer"]["normalizers"] if held["normalizer"] else []
        self.steps = [s["type"] for s in steps]
        split = next(p for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_at = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.tokens = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.special.items()}
        self.byte_level = bool(held["decoder"])
        self.pieces = decoder_pieces(self.tokens, self.byte_level)
        letters = byte_symbols()
        self.symbols = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.merges.suffix) for c in letters]
        self.stream = WordStream(self.merges)
        self.known, self.ids = Cache(), Cache()  # of words; of runs without white space and special tokens

    def normal(self, text: str) -> str:
        """The file's steps; white space only ends words, so replacing it by spaces needs no work."""
        if "NFC" in self.steps and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            text = text.replace("Σ", "σ").lower()
        return text

    def symbols_of(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.symbols[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return [k for k in symbols if k is not None]

    def learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs of characters other than white space, by their words, which all go through the transducer."""
        split = [[run] if run.isalpha() else self.word_at.findall(run) for run in runs]
        words = set(chain.from_iterable(split))
        known = self.known.held
        new = list(words.difference(known))
        if new and self.known.make_room(len(new), 5 * sum(map(len, new))):
            new = list(words)
        known.update(zip(new, (struct.pack(f"<{len(t)}I", *t) for t in self.stream.many([self.symbols_of(w) for w in new])), strict=True))
        return {r: b"".join(map(known.__getitem__, ws)) for r, ws in zip(runs, split, strict=True)}

    def runs(self, text: str) -> list[str]:
        """Runs without white space of a text without special tokens."""
        text = self.normal(text)
        return [r for r in regex.split(r"\p{White_Space}+", text) if r] if any(c in text for c in INFORMATION) else text.split()

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded UTF-8 of each text; special tokens in a text count as such."""
        split: list[list] = []
        for text in texts:
            parts: list = []
            if any(s in text for s in self.special):
                at = 0
                for m in self.special_at.finditer(text):
                    parts += [*self.runs(text[at : m.start()]), (self.special[m.group()],)]
                    at = m.end()
                parts += self.runs(text[at:])
            else:
                parts = self.runs(text)
            split.append(parts)
        every = set(chain.from_iterable(split))
        ids = self.ids.held
        new = every.difference(ids)
        if new and self.ids.make_room(len(new), 5 * sum(map(len, new))):
            new = every
        for special in [x for x in new if isinstance(x, tuple)]:
            ids[special] = struct.pack("<I", *special)
        ids.update(self.learn([x for x in new if isinstance(x, str)]))
        out = []
        for parts in split:
            raw = b"".join(map(ids.__getitem__, parts))
            machine = StreamDecoder(self.pieces, self.byte_level)
            text = machine.feed(memoryview(raw).cast("I")) + machine.finish()
            out.append((raw, text.encode()))
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker, kept from task to task."""
    return worker_cache(f"bpe {path}", lambda: WordTokenizer(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (text) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(path)
        fewer_collections()
        def made(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            found = own.encode_decode(texts)
            decoded = pa.array([f[1] for f in found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([f[0] for f in found], pa.binary()), decoded], ["doc_id", "ids", "decoded"])

        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > 4 << 20:
                    yield made(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
            yield made(doc_ids, texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")



def query(spark, sf_dir: str) -> DataFrame:
    """op9: digests of every document's ids and of the text decoded from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
