"""The pipeline against plain versions of its stages, and registered queries against their SQL."""

import random
from collections import Counter
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import languages, quality, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        after[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert 0 < after["near_duplicates"] <= after["language"] <= after["quality"] < 200
    assert docs.select("doc_id").distinct().count() == after["near_duplicates"]
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == after["near_duplicates"]


def test_language_stage(spark, sf_dir):
    """Foreign scripts, mixed texts and random letters go, clean documents stay, as by a plain version of the stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(1)
    made = {k: [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(5)] for k, letters in {"gibberish": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνο", "cyrillic": "абвгдежзиклмно"}.items()}
    long = {}
    for r in docs.filter("n_chars > 400").collect():
        long.setdefault(r["lang"], []).append(r["text"][:300])
    made["mixed"] = [" ".join(long[lang][k % len(long[lang])] for lang in sorted(long)) for k in range(5)]
    made["half"] = [long["en"][k] + " " + made["gibberish"][k][:300] for k in range(5)]
    planted = [t for texts in made.values() for t in texts]
    rows = [(-1 - k, t, None, "planted", len(t)) for k, t in enumerate(planted)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, both, sf_dir).collect()}
    assert not any(k < 0 for k in kept)
    clean = [r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert len(kept.intersection(clean)) >= 0.98 * len(clean)

    model = languages.fit_languages(both, F.lit(True))

    def plain(text):
        path = [lang for lang, a, b in languages.language_spans(text, model) for _ in range(a, b)]
        words, letters, above, length = languages.words_of(text), Counter(), 0.0, 0
        for word, lang, row in zip(words, path, model.word_scores(words) if words else [], strict=True):
            letters[lang] += sum(map(str.isalpha, word.decode()))
            length += len(word)
            above += row[model.langs.index(lang)] + log(languages.BUCKETS) * (len(word) + 0.5)
        total = letters.total()
        return any(map(str.isalpha, text)) and max(letters.values()) >= 0.6 * total and above >= 0.5 * length

    assert kept == {r["doc_id"] for r in both.collect() if plain(r["text"] or "")}


def test_quality_stage(spark, sf_dir):
    """A document stays if a plain loop over the fitted machine scores it so."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels.select("doc_id", "quality"), F.lit(True))
    plain = {r["doc_id"] for r in docs.collect() if model.scores([(r["text"] or "").encode()], quality.Buckets())[0] >= corpus_pipeline.LEAST_QUALITY}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, sf_dir).collect()}
    assert kept == plain
    assert 0 < len(kept) < docs.count()


def test_near_duplicate_stage(spark, sf_dir):
    """One row of each class stays, whatever repeats; the classes are those of all pairs."""
    rng = random.Random(2)
    a, b, c = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(80)) for x in "abc")
    rows = [(0, a), (0, b), (1, a + " more"), (1, a + " more"), (2, b + " more"), (3, ""), (3, None), (3, ""), (None, "  "), (None, c), (5, c.upper()), (6, "other words")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter([(0, a), (0, b), (3, ""), (None, "  "), (None, c), (6, "other words")])
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {}
    for r in real.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    gone = set()
    reach = {k: {k} for k in sets}
    for x in sets:
        for y in sets:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]) and reach[x] is not reach[y]:
                both = reach[x] | reach[y]
                for k in both:
                    reach[k] = both
    gone = {k for k in sets if min(reach[k]) != k}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, real, sf_dir).collect()} == set(sets) - gone


def test_packing_stage(spark, sf_dir):
    """All tokens of all documents are packed, each sequence gapless and no longer than 1024."""
    tokenizers = pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    sizes = Counter()
    for r in found:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()})
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = db.execute(queries.ORACLES[name]).fetchall()
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)
