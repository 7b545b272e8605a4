"""Scans with faults kept apart, kept indexes, the inverted index, bounded relevance and batched vector search."""

import os
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, relevance, vectors
from quarry.plans.retrieve import retrieve_by_index
from quarry.sources import files, kept, postings, scan


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "kb"
    (root / "sub/deep").mkdir(parents=True)
    (root / "a.txt").write_text("Root file")
    (root / ".hidden.md").write_text("")
    (root / "sub/b.md").write_text("# Nested\nContent in a subfolder.")
    (root / "sub/deep/c.csv").write_text("1,2")
    (root / "sub/b.md.chunks.jsonl").write_text("{}")
    (root / "odd?.txt").write_text("no")
    return root


def locked(name):
    """Opens files, but for one."""

    def opener(path):
        if path.endswith(name):
            raise PermissionError(path)
        return open(path, "rb")

    return opener


def test_catalogue_views(spark, folder):
    names = lambda *a, **b: [r.name for r in files.catalogue(spark, str(folder), *a, **b).collect()]
    assert names() == [".hidden.md", "a.txt", "sub/b.md", "sub/deep/c.csv"]
    assert names(recursive=False) == [".hidden.md", "a.txt"]
    assert names("sub") == ["b.md", "deep/c.csv"]
    assert names("sub", recursive=False) == ["b.md"]
    assert names("none") == []
    assert files.catalogue(spark, f"{folder}-missing").count() == 0
    for bad in ("../kb", "/etc", "sub/../.."):
        with pytest.raises(ValueError, match="leave the root"):
            files.catalogue(spark, str(folder), bad)
    row = files.catalogue(spark, str(folder)).filter("name = 'sub/b.md'").first()
    assert (row.filename, row.size, len(row.sha256)) == ("b.md", 32, 16)


def test_unreadable_file(spark, folder):
    found = {r.name: r.sha256 for r in files.catalogue(spark, str(folder), opener=locked("b.md")).collect()}
    assert found["sub/b.md"] == "unreadable"
    assert sum(s == "unreadable" for s in found.values()) == 1
    read = {r.name: r for r in scan.read_each(scan.listed(spark, str(folder)), str(folder), whole=True, opener=locked("b.md")).collect()}
    assert read["sub/b.md"].error.startswith("PermissionError")
    assert (bytes(read["a.txt"].content), read["a.txt"].error) == (b"Root file", None)


def test_a_folder_that_cannot_be_listed(folder):
    import pandas as pd

    got = next(scan._children(str(folder))(iter([pd.DataFrame({"folder": ["a.txt"]})])))
    assert got["error"][0]
    assert got["is_folder"].tolist() == [True]


def test_incremental_reindex(spark, folder, tmp_path):
    store, root = str(tmp_path / "store"), str(folder)
    done = kept.refresh_chunks(spark, root, store)
    assert (done.files, done.read, done.removed, done.failed) == (4, 4, 0, 0)
    expected = lambda: sorted((p.relative_to(folder).as_posix(), p.read_text()) for p in folder.rglob("*") if p.is_file() and p.suffix != ".jsonl" and "?" not in p.name and p.stat().st_size)
    shown = lambda: sorted((r.doc_id, r.text) for r in kept.chunks_of(spark, root, store).collect())
    joined = lambda: [(n, "\n".join(t.split("\n"))) for n, t in expected()]
    assert [n for n, _ in shown()] == [n for n, _ in joined()]
    again = kept.refresh_chunks(spark, root, store, opener=locked(""))  # opens no file, or it would fail
    assert (again.files, again.read, again.removed, again.failed) == (4, 0, 0, 0)
    (folder / "a.txt").write_text("Root file, longer")
    (folder / "sub/deep/c.csv").unlink()
    (folder / "new.txt").write_text("New")
    third = kept.refresh_chunks(spark, root, store, opener=locked("new.txt"))
    assert (third.files, third.read, third.removed, third.failed) == (3, 2, 1, 1)
    assert dict(shown())["a.txt"] == "Root file, longer"
    fourth = kept.refresh_chunks(spark, root, store)  # only what failed
    assert (fourth.files, fourth.read, fourth.removed, fourth.failed) == (4, 1, 0, 0)
    assert {n for n, _ in shown()} == {"a.txt", "new.txt", "sub/b.md"}
    (folder / "a.txt").write_text("x")
    assert kept.refresh_chunks(spark, root, store, most_segments=2).read == 1
    assert dict(shown()) | {"a.txt": "x"} == dict(shown())
    place = next(Path(store).iterdir())
    assert sum(p.name.startswith("segment") for p in place.iterdir()) == 1
    assert kept.refresh_chunks(spark, f"{root}-missing", store).files == 0
    tokens = {r.doc_id: r.tokens for r in kept.chunks_of(spark, root, store).collect()}
    assert tokens["new.txt"] == ["new"]


def counting(log, fails=False):
    def embed(texts):
        with open(log, "a") as out:
            out.writelines(t.replace("\n", " ") + "\n" for t in texts)
        if fails:
            raise RuntimeError("no model")
        return [[float(t.count("fire")), float(t.count("ice")), 0.1] if t else None for t in texts]

    return embed


def test_kept_vectors(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    seen = lambda: (Path(log).read_text().splitlines() if os.path.exists(log) else [], Path(log).write_text(""))[0]
    docs = spark.createDataFrame([("1", "p/a", "a.md", "fire fire"), ("2", "p/b", "b.md", "ice"), ("3", "p/c", "c.md", None)], "doc_id string, path string, display_name string, content string")
    other = docs.filter("doc_id = '2'")
    ids = lambda df: [r.doc_id for r in df.collect()]
    assert sorted(ids(kept.kept_vectors(docs, store, "one", counting(log)))) == ["1", "2"]
    assert sorted(seen()) == ["", "fire fire", "ice"]
    assert sorted(ids(kept.kept_vectors(docs, store, "one", counting(log)))) == ["1", "2"]
    assert seen() == []  # kept
    assert ids(kept.kept_vectors(other, store, "two", counting(log))) == ["2"]  # another root, another index
    assert seen() == ["ice"]
    changed = docs.withColumn("content", F.when(F.col("doc_id") == "2", "ice ice").otherwise(F.col("content")))
    assert sorted(ids(kept.kept_vectors(changed, store, "one", counting(log)))) == ["1", "2"]
    assert seen() == ["ice ice"]  # only what changed
    assert ids(kept.kept_vectors(docs.filter("doc_id = '1'"), store, "one", counting(log))) == ["1"]
    assert seen() == []  # what is gone needs no model
    assert kept.kept_vectors(docs, store, "three", lambda texts: [None] * len(texts)).count() == 0
    assert kept.versions(spark, f"{store}/{kept.hashlib.sha256(b'three').hexdigest()[:16]}", "vectors") == []  # never kept empty
    assert kept.kept_vectors(docs, store, "four", counting(log), dimension=4).count() == 0


def test_retrieval_by_kept_vectors(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "p/a", "a.md", "fire fire"), (2, "p/b", "b.md", "ice fire ice")], "doc_id long, path string, display_name string, content string")
    ids = lambda query, embed: [r.doc_id for r in retrieve_by_index(docs, query, "kb", store, embed).collect()]
    assert ids("fire", counting(log, fails=True)) == ["1", "2"]  # by keywords: 4 points against 2
    assert ids("ice", counting(log)) == ["2", "1"]
    assert ids("ice", counting(log)) == ["2", "1"]
    assert ids(" ", counting(log)) == []
    assert ids("ice", lambda texts: [None] * len(texts)) == []  # the index is kept, the query has no vector


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["hot"] * 10
    rows = [(d, c, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for d in range(40) for c in range(3)]
    made = chunking.indexed(spark.createDataFrame(rows, "doc_id long, chunk_ix int, text string"))
    foreign = spark.createDataFrame([(99, 0, "x", ["w1", "x1", "hot"], {}), (99, 1, "x", ["x1"], None), (99, 2, "x", None, {"w1": 0.2})], "doc_id long, chunk_ix int, text string, tokens array<string>, tfidf map<string,double>")
    return made.unionByName(foreign).cache()


@pytest.mark.parametrize("query", ["w1 w2 hot", "hot", "x1 x1 w3", "the of", "absent"])
def test_inverted_index(spark, index, tmp_path, query):
    path = str(tmp_path / "index")
    postings.write_index(index, path, 16)
    words = relevance.query_tokens(spark, query)
    rounded = lambda df: {(r.doc_id, r.chunk_ix): round(r.score, 9) for r in df.collect()}
    homes = spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, words)), lambda t: postings.bucket_of(t, 16))).alias("b")).first().b if words else []
    for p in Path(path, "postings").iterdir():  # what isn't asked for isn't read
        if p.name.startswith("bucket=") and int(p.name[7:]) not in homes[1:] + homes[:1] and len(homes):
            shutil.rmtree(p)
    got, want = postings.relevant_chunks(spark, path, query), relevance.relevant_chunks(index, query)
    assert rounded(got) == rounded(want)
    top = [(r.doc_id, r.chunk_ix) for r in relevance.relevant_chunks(index, query).limit(5).collect()]
    assert [(r.doc_id, r.chunk_ix) for r in postings.relevant_chunks(spark, path, query, 5).collect()] == top


def test_bounded_relevance(spark, index):
    for query in ("w1 w2 hot", "w5 w6 w7 w8 w9 w10 hot", "x1"):
        words = relevance.query_tokens(spark, query)
        every = [(r.doc_id, r.chunk_ix, r.score) for r in relevance.relevant_chunks(index, query).collect()]
        for n in (1, 3, 10, 1000):
            assert [(r.doc_id, r.chunk_ix, r.score) for r in relevance.relevant_chunks(index, query, n).collect()] == every[:n]
        hit = index.withColumn("base", relevance.base_score(F.col("tokens"), F.col("tfidf"), words)).filter("base > 0")
        bounds = hit.select(relevance.ratio_bound(F.col("tokens"), words).alias("b"), relevance.sequence_ratio(words)(F.col("tokens")).alias("r")).collect()
        assert all(x.r <= x.b for x in bounds)
    words = relevance.query_tokens(spark, "w1 w2 hot")
    hit = index.withColumn("base", relevance.base_score(F.col("tokens"), F.col("tfidf"), words)).filter("base > 0")
    assert relevance.contenders(hit, words, 3).count() < 0.2 * hit.count()  # four fifths need no comparison
    assert relevance.relevant_chunks(index, "hot", 0).count() == 0


def test_batched_vectors(spark, monkeypatch):
    rng = random.Random(8)
    nan = float("nan")
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(50)]
    rows += [(50, [0.0] * 4), (51, None), (52, [1.0, 2.0]), (53, [nan, 1.0, 0.0, 0.0]), (54, []), (55, rows[0][1]), (56, [1.0, None, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(k, v) for k, v in rows if k in (0, 3, 50, 51, 52, 54)], "q long, embedding array<float>")
    for numbers in (2_000_000, 9):  # one pass, or a query a pass
        monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
        got = {}
        for r in vectors.top_similar_many(table, asked, ["q"], 6).orderBy("place").collect():
            got.setdefault(r.q, []).append((r.vec_id, round(r.sim, 6)))
        finite = table.filter("vec_id NOT IN (53, 56)")
        want = {k: [(r.vec_id, round(r.sim, 6)) for r in vectors.top_similar(finite, v, 6).collect()] for k, v in rows if k in (0, 3, 52)}
        assert got == want
    assert vectors.top_similar_many(table, asked.limit(0), ["q"]).count() == 0
