"""Each corpus operator against brute force, round trips or held-out accuracy, and over awkward tables."""

import random
import sys
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, fingerprints, jaccard, languages, lm, neighbours, packing, quality, sharding, wrappers
from quarry.llm.common import remainder
from quarry.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, `Word` int"
LONG = "word " * 30_000 + "x" * 40_000


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    texts = [None, "", "   ", "a b c d e f", "a b c d e f", "A B C D E F", LONG, "…!?", "über straße", "naïve\x1ccafé x", "one two three four"]
    rows = [(k, t, None if k % 3 else "en", None, None, "s", "x", 1) for k, t in enumerate(texts)]
    rows += [rows[3], (None, "null id", "de", None, 1, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        pieces = packing.token_pieces(awkward, path, ranks_path=ranks, pattern=public_tokenizers.PATTERN)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, bytes(r.ids)) for r in pieces.collect())
        want = []
        for r in awkward.collect():
            ids = [*ids_of(r.text, tokenizer), 2]
            at = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
            want += [(r.doc_id is None, r.doc_id or 0, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(pairwise(at))]
        assert got == sorted(want)
    placed = packing.pack_pieces(pieces.drop("ids")).collect()
    assert len(placed) == len(want)
    for s in {r.sequence_id for r in placed}:
        own = sorted((r.offset, r.length) for r in placed if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    assert packing.pack_pieces(packing.token_pieces(nothing, path)).count() == 0


def packing_encoder(**more):
    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **more)


def test_packing_has_no_work_for_each_word():
    """Calls that Python makes while it encodes texts of many different words, which no cache holds, are few."""
    own = packing_encoder()
    texts = [" ".join(f"w{k * 7919 % 100_003:x}" for k in range(a, a + 10_000)) for a in (0, 10_000)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = own.encode(texts)
    finally:
        sys.setprofile(None)
    assert got == [own.slow(t) for t in texts]
    assert calls < 2_000


@pytest.mark.parametrize("budget", [16 << 20, 5_000])
def test_packing_parts(budget):
    """Ids as the tokenizer's for parts that are known, new, forgotten or not plain, and for texts with runs of white space."""
    rng = random.Random(4)
    letters = "aabceinrst'0.,<|>\u00e9\u024f\u0250\u0436\u4e2d\U0001f642\t\x1c\x85\u00a0\u2003\u0301"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(600)] + ["'s", "don't", "<|endoftext|>"]
    own = packing_encoder(budget=budget)
    for size in (0, 1, 40, 300):
        texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", seldom]) for _ in range(rng.randint(0, 8)))[: rng.choice([-1, 90])] for seldom in rng.choices([" ", "\n", "  ", " \n"], k=size)]
        assert own.encode(texts) == [own.slow(t) for t in texts]
        assert own.parts.nbytes + own.ids.nbytes <= max(budget, 100 * sum(map(len, texts)))


def test_bin_completion():
    rng = random.Random(3)

    def least(items, limit):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[k] <= limit:
                    bins[b] += items[k]
                    go(k + 1, bins)
                    bins[b] -= items[k]
            bins.append(items[k])
            go(k + 1, bins)
            bins.pop()

        go(0, [])
        return best

    for items, limit, bins in (([4, 5, 5, 10, 11, 11, 13, 13, 14, 15, 18], 30, 4), ([3, 4, 5, 5, 5, 7, 7, 7, 8, 8, 9, 9, 9, 10, 11, 13], 20, 6)):
        assert sum(t for t, _ in packing.complete_bins(dict(Counter(items)), limit)) == bins
    for _ in range(400):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = dict(Counter(items))
        plan = packing.complete_bins(counts, 20)
        assert sum(t for t, _ in plan) == least(items, 20)
        used = Counter()
        for times, filling in plan:
            assert sum(filling) <= 20
            for k in filling:
                used[k] += times
        assert used == counts


def test_fillings():
    """All undominated fillings and no others, least waste first, against all subsets."""
    rng = random.Random(5)
    for _ in range(150):
        room = rng.randint(1, 25)
        left = Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 8)))
        items = sorted(left.elements())
        every = {tuple(sorted((items[k] for k in range(len(items)) if m >> k & 1), reverse=True)) for m in range(1 << len(items))}
        every = [f for f in every if sum(f) <= room]

        def beaten(f, left=left, room=room):
            for x, n in left.items():
                if f.count(x) < n:
                    for m in range(1 << len(f)):
                        s = [f[k] for k in range(len(f)) if m >> k & 1]
                        if x not in s and sum(s) <= x and sum(f) - sum(s) + x <= room:
                            return True
            return False

        got = list(packing.fillings(dict(left), sorted(left), room))
        assert sorted(tuple(f) for _, f in got) == sorted(f for f in every if not beaten(f))
        assert [w for w, _ in got] == sorted(w for w, _ in got)
        assert all(w == room - sum(f) for w, f in got)


def test_sharding(spark, awkward, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.shard_documents(docs, 4, 0.01).withColumn("size", sharding.size_of()).collect()
    total = sum(r["size"] for r in got)
    for k in range(4):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= total / 4 * 0.02 + max(r["size"] for r in got)
    copies = docs.select("doc_id", F.lit("same text").alias("text"))  # one hot group
    sizes = Counter(r["shard"] for r in sharding.shard_documents(copies, 4).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    small = sharding.shard_documents(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "copy").otherwise(F.col("text")).alias("text")), 4, cell_bytes=2000).collect()
    for k in range(4):
        assert sorted(r["slot"] for r in small if r["shard"] == k) == list(range(sum(r["shard"] == k for r in small)))
    assert sorted(r["doc_id"] for r in small) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    repeated = spark.createDataFrame([(None, None)] * 4000 + [(k, "x" * 100) for k in range(50)], "doc_id long, text string").repartition(3)
    spread = sharding.shard_documents(repeated).withColumn("size", sharding.size_of()).groupBy("shard").agg(F.sum("size").alias("n"), F.max("slot").alias("last"), F.count("*").alias("rows")).collect()
    assert len(spread) == 16
    assert all(abs(r["n"] - 9050 / 16) <= 101 for r in spread)
    assert all(r["last"] == r["rows"] - 1 for r in spread)
    got = sharding.shard_documents(awkward)
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == Counter((r["doc_id"], r["text"], r["lang"]) for r in awkward.collect())
    assert sorted(got.columns) == sorted([*awkward.columns, "slot"])
    assert sharding.shard_documents(nothing).count() == 0


def test_languages(spark, awkward, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = languages.fit_languages(docs, remainder("doc_id", 5) != 0)
    held = languages.predict_languages(docs, model).filter(remainder("doc_id", 5) == 0).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.93
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.predict_languages(awkward, model).collect()}
    assert got[0] == got[1] == got[7] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = languages.fit_languages(nothing, F.lit(True))
    assert {r["lang_pred"] for r in languages.predict_languages(awkward, empty).collect()} == {"und"}
    assert languages.predict_languages(nothing, model).count() == 0


def test_words_and_letters():
    assert languages.words_of("Don’t\u00a0stop\u3000été—ok日本 x1y") == [w.encode() for w in ("don", "t", "stop", "été", "ok", "日", "本", "x", "y")]
    assert languages.letters_of(languages.words_of("été ok 日本 हिन्दी")).tolist() == [3, 2, 1, 1, 3]


def test_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, k, penalty = int(rng.integers(1, 6)), 3, float(rng.random() * 3)
        sizes = np.sort(rng.integers(0, 6, n))[::-1]
        scores = rng.normal(size=(10, k)).astype(np.float32)
        index = rng.integers(0, 10, sizes.sum())
        path, at = languages.viterbi(index, sizes, scores, penalty), 0
        for size in sizes:
            own = index[at : at + size]
            best = max((sum(scores[w, p] for w, p in zip(own, c, strict=True)) - penalty * sum(a != b for a, b in pairwise(c)) for c in np.ndindex(*[k] * size)), default=0)
            mine = path[at : at + size]
            assert sum(scores[w, p] for w, p in zip(own, mine, strict=True)) - penalty * sum(a != b for a, b in pairwise(mine)) == pytest.approx(best, abs=1e-4)
            at += size


def test_fingerprints(spark, awkward, nothing):
    rng = random.Random(5)
    a, b = ("".join(rng.choice("ab") for _ in range(300)) for _ in range(2))
    x, y = (fingerprints.PrefixHash(fingerprints.codes(t)) for t in (a, b))
    for _ in range(300):
        i, j = rng.randrange(300), rng.randrange(300)
        n = next((k for k in range(300) if i + k >= 300 or j + k >= 300 or a[i + k] != b[j + k]), 300)
        assert fingerprints.longest_common_extension(x, i, y, j) == n
    rows = spark.createDataFrame([(k, f"text {k} " + "".join(rng.choice("abcdef ") for _ in range(rng.randrange(400)))) for k in range(50)], "doc_id long, text string").repartition(5)
    texts = dict(sorted(map(tuple, rows.collect())))
    for r in fingerprints.fingerprint_edits(rows, 7).collect():
        own, following = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 50]
        half = len(own) // 2
        assert r["edited"] == own[: len(own) - half] + following[:half]
        assert r["n_chars"] == len(own)
        assert r["near_edited"] == fingerprints.fingerprint_likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["edited_fingerprint"] == fingerprints.parts(fingerprints.codes(r["edited"]))[0]
        assert r["near_next"] == fingerprints.fingerprint_likeness(r["fingerprint"], fingerprints.parts(fingerprints.codes(following))[0])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (r["same_edited"], r["same_next"]) == (common(own, r["edited"]), common(own, following))
    got = fingerprints.fingerprint_edits(awkward).collect()
    assert len(got) == 13
    same = {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    assert fingerprints.fingerprint_edits(nothing).count() == 0


def test_fingerprints_of_large_ids(spark):
    rows = [((1 << 62) + 1_000_003 * k * k, f"text {k}") for k in range(300)] + [((1 << 63) - 1, "last"), (-5, "first")]
    following = dict(zip(sorted(r[0] for r in rows), [*sorted(r[0] for r in rows)[1:], -5], strict=True))
    texts = dict(rows)
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 40).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        own, after = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        assert r["edited"] == own[: len(own) - len(own) // 2] + after[: len(own) // 2]


def brute_components(texts, width=5, percent=75):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_jaccard(spark, awkward, nothing):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)] for _ in range(4)]
    texts = {}
    for k in range(160):
        words = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"new{rng.randrange(30)}"
        texts[k] = " ".join(words[: rng.randrange(45, 61)])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(rows).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) > 4
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(awkward).collect()}
    assert got[3] == got[4] == got[5] == (2, 3)
    assert got[0] == (0, 0)
    assert got[2] == (0, 2)
    assert got[None] == (1, None)
    assert jaccard.link_classes(nothing).count() == 0


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """A thousand sets: one hot group of near copies, others near its edge, copies, and blocks of a few entries."""
    monkeypatch.setattr("quarry.llm.common.FEW", 10)
    for name, value in (("BLOCK", 16), ("PARTNERS", 8), ("PROBES", 4), ("CHUNK", 5_000)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(1000):
        if k % 3 == 0:  # hot: few changes
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] = f"x{rng.randrange(500)}"
        elif k % 3 == 1:  # some of the base, some of its own
            cut = rng.randrange(30, 60)
            words = base[:cut] + [f"y{k}z{j}" for j in range(rng.randrange(25))]
        else:
            words = [f"v{rng.randrange(12)}" for _ in range(rng.randrange(1, 30))]
        texts[k] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(rows).collect()}
    assert got == brute_components(texts)


def test_prefix_tree():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(80)]
    tree = jaccard.PrefixTree(sets, list(range(80)), [len(s) for s in sets], 75)
    for s in sets:
        want = [k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert sorted(tree.search(s, len(s))) == want
        assert bool(tree.search(s, len(s), True)) == bool(want)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r["id"], r["component"]) for r in components(links).collect()} == {(k, 1) for k in range(1, 41)} | {(100, 100), (101, 100)}


def test_quality(spark, awkward, nothing, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, remainder("doc_id", 5) != 0)
    held = quality.score_quality(docs, model, ["doc_id"]).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0).collect()
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in held) / len(held) > 0.8
    rng = np.random.default_rng(1)
    row, bucket, value, stats = quality.features([b"a b c", b""], quality.Buckets())
    model.factors[:] = rng.normal(size=model.factors.shape)
    raw, _ = model.sums(2, row, bucket, value, stats)
    for k in range(2):
        x = np.zeros(len(model.linear))
        x[bucket[row == k]] = value[row == k]
        x[quality.BUCKETS :] = stats[k]
        used = np.flatnonzero(x)
        pairs = sum(x[i] * x[j] * (model.factors[i] @ model.factors[j]) for i in used for j in used if i < j)
        assert raw[k] == pytest.approx(model.bias + model.linear @ x + pairs)
    assert quality.score_quality(awkward, model, ["doc_id"]).count() == 13
    none = quality.fit_quality(nothing, labels, F.lit(True))
    assert {round(r["score"], 6) for r in quality.score_quality(awkward, none, ["doc_id"]).collect()} == {0.5}


def test_bpe(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    rng = random.Random(1)
    letters = "aaabcdeéßİΣσς \n\t\x1c\x85\xa0'’sS1²½中文日本한 🎉👩‍👧é<!?#…ñ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["x<|endoftext|>The", "", "a" * 5000, "ab" * 4000, "".join(rng.choice("aeinrst") for _ in range(9000)), "don't it's I'LL"]
    for text, (ids, decoded) in zip(texts, own.encode_decode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes()
        assert decoded.decode() == tokenizer.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_texts(awkward, path).collect()}
    assert got == {r.doc_id: np.array(ids_of(r.text, tokenizer), "<u4").tobytes() for r in awkward.collect()}
    assert bpe.encode_texts(nothing, path).count() == 0


def test_transducer():
    """Windows of any length give what merging whole words gives, for one word and for many."""
    rng = random.Random(9)
    for _ in range(60):
        vocab = {c: k for k, c in enumerate("abc")}
        merges = []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 8:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        own = bpe.Merges(vocab, merges)
        words = [[rng.randrange(3) for _ in range(rng.randrange(1, 200))] for _ in range(20)]
        want = [own.apply(w) for w in words]
        stream = bpe.WordStream(own, slack=1)
        assert stream.many(words) == want
        assert [[*stream.feed(w), *stream.finish()] for w in words] == want


def test_stream_decoder():
    symbols = bpe.byte_symbols()
    raw = "né 🎉".encode()
    machine = bpe.StreamDecoder(bpe.decoder_pieces(dict(enumerate(symbols[b] for b in raw)), True), True)
    assert "".join(machine.feed([k]) for k in range(len(raw))) + machine.finish() == "né 🎉"


def test_wrappers(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Menu</a></nav><article><h1>Head {k}</h1>{body}</article><div class='comments'><p>nice {k}</p></div><footer>&copy; us</footer></body></html>"
    bodies = ["<p>One &amp;  two</p><p>Three<br>four</p>", "<p><b>x<br><p>y</p>", "<aside><p>side</p></aside><p>z</p>", ""]
    plain = "<body><div id='top'>Site</div><div class='text'><p>Words {k}</p></div><div>Made by us</div></body>"
    rows = [(k, "http://a.example/x", page.format(k=k, body=b), 1) for k, b in enumerate(bodies)]
    rows += [(k, "http://b.example/", plain.format(k=k), 1) for k in range(10, 14)] + [(20, None, None, 1), (21, "x", "", 1), (None, "http://a.example/x", page.format(k=9, body=""), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(pages, wrappers.infer_wrappers(pages)).collect()}
    assert got[0] == "Head 0\nOne & two\nThree\nfour"
    assert got[1] == "Head 1\nx\ny"
    assert got[2] == "Head 2\nz"
    assert got[3] == "Head 3"
    assert got[10] == "Words 10"
    assert got[20] == got[21] == ""
    assert wrappers.fold([["<", "ul"], ["<", "li"], ["#", "t"], ["<", "li"], ["#", "t"], ["<", "/ul"]]) == [["<", "ul"], ["+", [["<", "li"], ["#", "t"]]], ["<", "/ul"]]
    assert wrappers.align([["<", "a"], ["<", "b"]], [["<", "a"]]) == [["<", "a"], ["?", [["<", "b"]]]]
    few = wrappers.extract_text(pages, wrappers.infer_wrappers(pages), broadcast_hosts=0)
    assert {r["page_id"]: r["text"] for r in few.collect()} == got
    assert wrappers.extract_text(pages.limit(0), wrappers.infer_wrappers(pages.limit(0))).count() == 0


def test_language_model(spark, awkward, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = remainder("doc_id", 7)
    got = lm.score_texts(docs, part != 2).collect()
    counts = Counter(w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in lm.tokens(r.text.encode()))
    total, distinct = sum(counts.values()), len(counts)
    texts = {r.doc_id: lm.tokens(r.text.encode()) for r in docs.collect()}
    for r in got:
        words = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    rows = lm.score_texts(awkward, part != 2).collect()
    assert len(rows) == 13
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (0, 1, 2))
    assert lm.score_texts(nothing, part != 2).count() == 0
    assert {(r["train_tokens"], r["n_known"]) for r in lm.score_texts(awkward, F.lit(False)).collect()} == {(0, 0)}


def test_language_model_grows(spark):
    """Words with vectors grow with the vocabulary; probabilities are those of a plain softmax and add up to one."""
    words = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).cast("binary").alias("word"), (F.col("id") % 7 + 1).alias("n"))
    vocab = lm.vocabulary(words)
    assert vocab.words == lm.words_for(300_000) > lm.vocabulary(words.limit(1000)).words
    assert vocab.weight.sum() == vocab.total
    model = lm.LogBilinear(vocab)
    model.W += np.random.default_rng(1).normal(size=model.W.shape).astype(np.float32)
    before = np.array([[3], [70], [vocab.words + 5], [0]])
    guess = sum(model.Q[before[i, 0]] * model.scale[i] for i in range(lm.CONTEXT))
    exps = lambda x: np.exp(x) / np.exp(x).sum()
    outer = exps(model.C[:, :-1] @ guess + model.C[:, -1])
    want = np.zeros(vocab.words + lm.REST)
    want[: model.single], want[vocab.words :] = outer[: model.single], outer[vocab.rest :]
    for g, (a, b) in enumerate(zip(model.edges, model.edges[1:], strict=False)):
        want[a:b] = outer[model.single + g] * exps(model.W[a:b, :-1] @ guess + model.W[a:b, -1])
    units = np.arange(len(want))
    found = 10 ** model.log10_probabilities(model.predict(np.repeat(before, len(units), axis=1)), vocab.classes(units), units)
    assert np.allclose(found, want, atol=1e-6)
    assert found.sum() == pytest.approx(1, abs=1e-4)
    inside = 10.0 ** (np.log10(2) - vocab.inner)  # an unknown word's and a once seen word's share of a rest class
    assert (inside < 1).all()


def test_language_model_learns():
    """Training makes the word that follows likelier than its frequency says."""
    counts = np.array([100, *[50] * 199], np.int64)
    edges = np.array([lm.SINGLE, 120, 200])
    of_word = np.concatenate([np.arange(lm.SINGLE), np.repeat([lm.SINGLE, lm.SINGLE + 1], [120 - lm.SINGLE, 80])])
    weight = np.concatenate([np.bincount(of_word, counts), np.zeros(lm.REST)])
    vocab = lm.Vocabulary({}, counts, 200, of_word, edges, weight, np.zeros(lm.REST), int(counts.sum()), 200)
    model, rng = lm.LogBilinear(vocab), np.random.default_rng(0)
    model.start_training()
    units = np.empty(40_000, np.int64)
    units[::2] = rng.integers(1, 100, 20_000)
    units[1::2] = units[::2] + 100
    sizes = np.array([3, 1, 2, len(units) - 6])
    places = lm.places_of(sizes)
    for at in (0, 2, 6, 5000):
        plain = [[units[t - 1 - i] if places[t] > i else 0 for t in range(at, at + 50)] for i in range(lm.CONTEXT)]
        assert np.allclose(model.predictions(units, places, at, 50, model.window(units, at, 50)), model.predict(np.array(plain)))
    for _ in range(3):
        model.train(units, places, vocab.classes(units), rng)
    logs = model.text_log10(units, places, vocab.classes(units))[1:2001:2]
    assert logs.mean() > np.log10(1 / 200) + 0.6


def test_neighbours(spark, nothing):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[40:80] = x[40]  # copies
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0], 0), (None, x[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 10).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, got in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for v, _ in got} & set(np.lexsort((np.arange(1500), -s))[:10].tolist()))
        assert len(got) == 10
        assert [v for v, _ in got] == [v for v, _ in sorted(got, key=lambda p: (-p[1], p[0]))]
        assert all(p == pytest.approx(x[v] @ x[q]) for v, p in got)
    assert hits / (10 * len(by)) > 0.95
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [2, 12, 30, 45, 60, 100, 1000])
def test_neighbours_of_few(spark, n):
    """Small tables, by the same path as large ones."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    every = neighbours.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    got, hits, wanted = {}, 0, 0
    for r in every.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.argsort(-s, kind="stable")[: min(20, n - 1)].tolist())
        assert len(got[q]) == len(want)
        hits, wanted = hits + len(want & got[q]), wanted + len(want)
    assert hits >= 0.95 * wanted


def test_neighbours_in_blocks(spark, monkeypatch):
    """Several blocks and parts of queries find what brute force finds; repeated ids and many copies do no harm."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    monkeypatch.setattr("quarry.llm.common.FEW", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 12))
    x[400:800:5] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist())]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 20 == 0, 10).collect()
    hits = 0
    for q in range(0, 1200, 20):
        got = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got) == len(set(got)) == 10
        hits += len(set(got) & set(np.lexsort((np.arange(1200), -np.round(s, 9)))[:10].tolist()))
    assert hits / 600 > 0.95


def extracted(spark, htmls, **more):
    pages = spark.createDataFrame([(k, "http://c.example/x", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(wrappers.extract_text(pages, wrappers.infer_wrappers(pages, **more)).collect())]


def test_wrapper_slots(spark):
    """The wrapper tells a template slot from an article slot at the same path; all pages match it."""
    htmls = [f"<article><h1>Head {k}</h1><p>Read this first</p><ul><li>x</li></ul>" + "".join(f"<p>Text {k} {i}</p>" for i in range(1 + k % 3)) + "</article>" for k in range(9)]
    want = [f"Head {k}\n" + "\n".join(f"Text {k} {i}" for i in range(1 + k % 3)) for k in range(9)]
    for most in (2, 8):
        assert extracted(spark, htmls, most=most) == want
    same = ["<article><h1>One</h1><p>copied</p></article>"] * 5
    assert extracted(spark, same) == ["One\ncopied"] * 5
    rng = random.Random(6)
    for _ in range(100):
        pages = ["".join(rng.choice(["<p>a</p>", "<div>b</div>", "<ul><li>c</ul>", "<p class=k>d</p>", "e<br>f"]) for _ in range(rng.randrange(9))) for _ in range(6)]
        wrapper = wrappers.stream(pages[0])
        for p in pages[1:]:
            wrapper = wrappers.align(wrapper, wrappers.stream(p))
        matcher = wrappers.Matcher(wrapper)
        assert all(matcher.match(wrappers.nodes_of(list(wrappers.blocks(p)))[0]) is not None for p in pages)


def test_wrapper_layouts(spark):
    """A hidden block costs only its own text; pages of another layout keep theirs."""
    htmls = [f"<article><p hidden>secret {k}</p><p>shown {k}</p></article>" if k == 0 else f"<article><p>first {k}</p><p style='display:none'>secret</p><p>shown {k}</p></article>" for k in range(4)]
    htmls += [f"<div class='text'><p>plain {k}</p></div>" for k in range(4, 8)]
    assert extracted(spark, htmls) == ["shown 0", *(f"first {k}\nshown {k}" for k in range(1, 4)), *(f"plain {k}" for k in range(4, 8))]


def test_markup_without_ends(spark):
    def text(page):
        return [b[2] for b in wrappers.blocks(page) if b[0] == "text" and not b[3]]

    assert text("<html><head><title>t</title><meta charset=x><body><p>kept</p>") == ["kept"]
    assert text("<head><title>t</title><article><p>kept</p></article>") == ["kept"]
    assert text("<head><title>t</title><b>bold</b> words") == ["bold words"]
    assert text("<article><svg viewBox='0'/><p>kept</p></article>") == ["kept"]
    assert text("<p>a<svg><title>x</title><path d=''/></svg>b</p>") == ["ab"]
    for name in ("button", "select", "noscript", "object"):
        assert text(f"<article><p>a</p><{name}>Go<p>kept</p></article><p>b</p>") == ["a", "kept", "b"]
        assert text(f"<article><{name}><div>Go</div></{name}><p>kept</p></article>") == ["kept"]
    deep = "<div>" * 300
    found = [(b[2], b[3], b[4]) for b in wrappers.blocks(f"<nav>{deep}menu{'</div>' * 300}</nav><article>{deep}<p>in</p>{'</div>' * 300}<p>after</p></article><p>end</p>") if b[0] == "text"]
    assert found == [("menu", True, False), ("in", False, True), ("after", False, True), ("end", False, False)]


def test_bin_completion_ends():
    """Hard tables end in seconds, and bounds see a common divisor and lengths that share a bin with few others."""
    import time

    rng = random.Random(0)
    tables = {
        "half": ([rng.randint(340, 520) for _ in range(1000)], 1024), "even": ([2 * rng.randint(1, 150) for _ in range(2000)], 1023),
        "threes": ([3 * rng.randint(10, 200) for _ in range(2000)], 1024), "large threes": ([3 * rng.randint(100, 341) for _ in range(2000)], 1024),
    }
    for name, (lengths, limit) in tables.items():
        counts = Counter(lengths)
        began = time.thread_time()
        plan = packing.complete_bins(dict(counts), limit)
        assert time.thread_time() - began < 12, name
        assert sum((Counter({k: times * filling.count(k) for k in set(filling)}) for times, filling in plan), Counter()) == counts
        assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(dict(counts), limit))
    assert packing.waste_bound({4: 7}, 11) == 4  # two to a bin
    assert packing.waste_bound({340: 9, 341: 1}, 1022) == 4


def test_wrapper_decisions(spark):
    """Roots stay whatever their class; headings stay; templates show on two pages; copies of a page don't make one."""
    share = [f"<article class='post share'><h1>Same head</h1><p>Text {k} of its own</p><p>More {k} words here</p><p>The end</p></article>" for k in range(3)]
    assert extracted(spark, share) == [f"Same head\nText {k} of its own\nMore {k} words here\nThe end" for k in range(3)]
    plain = [f"<body><div class=a><div>Home</div><div>About us</div><div>Contact</div></div><div class=b><div>Story {k} is told here at some length</div><div>It ends {k}</div></div><div class=c>All rights reserved</div></body>" for k in range(2)]
    assert extracted(spark, plain) == [f"Story {k} is told here at some length\nIt ends {k}" for k in range(2)]
    copies = [f"<div><p>A long paragraph that all copies of this page share word by word</p><p>Short too</p><p>Edited {k}</p></div>" for k in range(4)]
    assert extracted(spark, copies) == [f"A long paragraph that all copies of this page share word by word\nShort too\nEdited {k}" for k in range(4)]
    long = ["<article>" + "".join(f"<p>Paragraph {i} of page {k}</p>" for i in range(3000)) + "</article>" for k in range(2)]
    assert extracted(spark, [*long, long[0]]) == ["\n".join(f"Paragraph {i} of page {k}" for i in range(3000)) for k in (0, 1, 0)]
