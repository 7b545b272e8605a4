"""Work that grows with the tables only: many questions against many documents, and what an index takes on disk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, questions
from quarry.plans import queries as library
from quarry.sources import postings

DOCS = "doc_id long, display_name string, content string"


def test_reader_as_term_points():
    rng = random.Random(4)
    parts = ["fire", "_", "ire", "FIRE", "fire_ice", "Ice", "icefire", " ", "é", "İce", "\n", "\r\n", "\x0b", "1", "firefirefirefirefirefire"]
    terms = ["fire", "ire", "ice", "fire_", "efi", "txt"]
    numbers, count, read = {t: k for k, t in enumerate(terms)}, questions.automaton(terms), questions.reader(terms)
    for _ in range(1500):
        name, content = "".join(rng.choices(parts, k=3)) + rng.choice([".txt", "", " x"]), "".join(rng.choices(parts, k=rng.randrange(40)))
        got = dict(zip(*(x.tolist() for x in read(name, content)), strict=True))
        assert got == questions.term_points(name, content, numbers, count), (name, content)
    assert [len(x) for x in questions.reader([])("a.txt", "fire")] == [0, 0]


def test_small_documents_are_left_to_bounds(monkeypatch):
    """Ten times the documents take far less than ten times the sums, and the best ones stay the same as by all sums."""
    rng = np.random.default_rng(6)
    asked, words = 500, 60
    members = np.repeat(np.arange(asked, dtype=np.int32), 6)
    terms = np.concatenate([rng.choice(words, 6, replace=False) for _ in range(asked)]).astype(np.int32)
    wanted = np.zeros((asked, words), np.int64)
    wanted[members, terms] = 1
    summed = []
    plain = questions.sums
    monkeypatch.setattr(questions, "sums", lambda points, flat, sizes: (summed.append(len(sizes)), plain(points, flat, sizes))[1])
    spent = {}
    for docs in (2_000, 20_000):
        points = rng.integers(0, 6, (docs, words)) * (1 + (rng.pareto(1.2, docs) * 3).astype(np.int64).clip(0, 200))[:, None]
        summed.clear()
        board = questions.Board(terms, members, asked, 3)
        for k, row in enumerate(points):
            at = np.flatnonzero(row).astype(np.int32)
            board.add_arrays(f"{k:06}", k, at, row[at].astype(np.int32))
        question, score, doc = board.tidy(filled=True)
        every = wanted @ points.T
        best = np.argsort(-every, axis=1, kind="stable")[:, :3]
        assert np.array_equal(doc.reshape(asked, 3), best)
        assert np.array_equal(score.reshape(asked, 3), np.take_along_axis(every, best, 1))
        spent[docs] = sum(summed)
    assert spent[20_000] < 0.05 * asked * 20_000
    assert spent[20_000] < 4 * spent[2_000]


def test_long_documents_first(spark, monkeypatch):
    """With scores of a few long documents known, tasks hand on less, and the result is the same; ties and rests too."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "aeio" for c in "xyz"]
    docs = spark.createDataFrame([(k, f"n{rng.randrange(80)}.md", "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(rng.randrange(1, 60)))) for k in range(400)], DOCS).repartition(8)
    asked = spark.createDataFrame([(k, " ".join(rng.sample(words, 3)) if k % 10 else rng.choice(["", "absent", "n3"])) for k in range(300)], "q long, question string")
    handed = lambda found: sum(r.n for r in found.groupBy("q").agg(F.count("*").alias("n")).collect())
    columns = ["q", "place", "doc_id", "display_name", "score"]
    plain = questions.top_documents_many(docs, asked, ["q"], 4)
    monkeypatch.setattr(questions, "SEEDED", 1)
    monkeypatch.setattr(questions, "SEEDS", 40)
    found, floored = [], questions.floors
    monkeypatch.setattr(questions, "floors", lambda *a: (found.append(floored(*a)), found[-1])[1])
    seeded = questions.top_documents_many(docs, asked, ["q"], 4)
    assert sorted(map(tuple, seeded.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    assert handed(seeded) == handed(plain) == 1200
    least = [r.score for r in plain.filter("place = 4").orderBy("q").collect()]
    assert len(found) == 1
    assert (found[0] > 0).mean() > 0.8
    assert max(found[0]) <= max(least)


@pytest.mark.parametrize("block", [7, 1000])
def test_keys_of_any_kind(spark, block):
    """Keys come back as they were given, in blocks whose bounds lie within the batches of questions."""
    docs = spark.createDataFrame([(1, "a.md", "fire"), (2, "b.md", "ice")], DOCS)
    asked = spark.range(40).select(F.struct(F.col("id").alias("a"), F.lit("x").alias("b")).alias("k"), F.expr("timestamp_seconds(id)").alias("t"), F.when(F.col("id") % 2 == 0, "fire").otherwise("ice").alias("question"))
    got = questions.top_documents_many(docs, asked, ["k", "t"], 1, block=block)
    assert sorted((r.k.a, r.doc_id) for r in got.collect()) == [(k, 1 + k % 2) for k in range(40)]
    assert got.join(asked, ["k", "t"]).count() == 40


def test_lines_are_cut_alike(spark):
    """Tasks cut texts as the column function does, from the part of them that they get."""
    from quarry.functions import text as T

    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", "b\n", "\n\n"], k=rng.randrange(1, 14))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    texts += ["", "\n", "a\nb\nc\nd", "a\nb\nc\nd\n", "a\nb\nc\nd\n\n", "a\u2028b\u2029\x1d\x1e\x0cc"] + ["".join(rng.choices(["a", "\n", " "], k=rng.randrange(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    all_lines = T.lines(F.col("content"))
    plain = F.when(F.size(all_lines) > 4, F.concat(F.array_join(F.slice(all_lines, 1, 4), "\n"), F.lit("\n" + T.TRUNCATED))).otherwise(F.array_join(all_lines, "\n"))
    for r in rows.select("content", plain.alias("plain"), T.truncate_lines(F.col("content"), 4).alias("cut"), F.substring_index("content", "\n", 6).alias("part")).collect():
        assert questions.truncated(r.part, 4) == r.cut == r.plain, r
    assert rows.select(T.truncate_lines(F.lit(None).cast("string"))).first()[0] is None


def test_index_of_whole_documents(spark, tmp_path):
    """As the index that exchanges texts and tokens, but nothing is exchanged; the written postings are the same."""
    rng = random.Random(12)
    words = ["fire", "ice", "the", "x-ray", "of", "dragon", "Fire", "é", "1a"]
    texts = [None, "", "\n\n", "the of"] + ["\n".join(" ".join(rng.choices(words, k=rng.randrange(7))) for _ in range(rng.randrange(1, 9))) for _ in range(700)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    whole = chunking.indexed_whole(docs, F.split("text", "\n"))
    plain = chunking.indexed(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_ix", "text")))
    shown = lambda df: {(r.doc_id, r.chunk_ix): (r.tokens, r.tfidf and {t: round(w, 12) for t, w in r.tfidf.items()}) for r in df.collect()}
    assert shown(whole) == shown(plain)
    assert whole.count() == plain.count()
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    read = {}
    for name, index, dealt in (("plain", plain, True), ("whole", whole, False)):
        path = str(tmp_path / name)
        postings.write_index(index, path, 8, dealt)
        scores = postings.base_scores(spark, path, ["fire", "x-ray", "fire"]).collect()
        hits = postings.relevant_chunks(spark, path, "fire x-ray dragon", 20).collect()
        read[name] = {(r.doc_id, r.chunk_ix): round(r.base, 9) for r in scores}, [(r.doc_id, r.chunk_ix, r.tokens, round(r.score, 9)) for r in hits]
    assert read["plain"] == read["whole"]
    assert len(read["plain"][0]) > 500


def test_indexed_relevance_exchanges_no_text(spark, tmp_path, monkeypatch):
    """Documents of one row each are weighed where they are read; rows that share a doc_id are brought together first."""
    rows = [(1, "reation a\nerthine"), (1, "reation\neaha b"), (2, "ndonle"), (4, "eaha eaha"), (5, "eaha c"), (3, None)]
    used, whole = [], chunking.indexed_whole
    monkeypatch.setattr(chunking, "indexed_whole", lambda *a: (used.append(1), whole(*a))[1])
    for name, some in (("once", rows[:1] + rows[2:]), ("repeated", rows)):
        spark.createDataFrame(some, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        used.clear()
        got = library.QUERIES["indexed_relevance"](spark, str(tmp_path / name)).collect()
        assert len(used) == (name == "once")
        if name == "once":
            assert sorted(map(repr, got)) == sorted(map(repr, library.QUERIES["relevance_base"](spark, str(tmp_path / name)).collect()))
        assert {r.doc_id for r in got} == {1, 2, 4, 5}
