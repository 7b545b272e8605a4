"""Hand-computed cases of the retrieval and conversation operators."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, history, keyword, personas, relevance, reminders, splitting, vectors
from quarry.plans.model import apply_model
from quarry.plans.retrieve import retrieve
from quarry.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "content", "terms", "points"),
    [
        ("dragon_lore.txt", "DragonKing\nthe dragon dragon", ["dragon"], 29),
        ("x.md", " ".join(["dragon"] * 6), ["dragon"], 8),
        ("x.txt", "nothing", ["txt"], 15),
        ("x.md", "", ["txt"], 0),
    ],
)
def test_keyword_points(spark, name, content, terms, points):
    assert value(spark, keyword.score(F.lit(name), F.lit(content), terms)) == points


def test_terms_and_names(spark):
    assert T.terms_of("What about the Dragon_King dragon 12ab?") == ["dragon_king", "dragon"]
    assert value(spark, T.query_terms(F.lit("What about the Dragon_King dragon 12ab?"))) == ["dragon_king", "dragon"]
    for name, shown in (("70_Species.txt", "_Species.txt"), ("2024.txt", "2024.txt"), ("x.MD", "x.MD")):
        assert value(spark, T.display_name(F.lit(name))) == shown
    for name, ext in ((".txt", ""), ("a.TXT", ".txt"), ("b.md?x=1.y", ".md"), ("noext", "")):
        assert value(spark, T.extension(F.lit(name))) == ext
    for name, safe in (("bad_notes.txt", "notes.txt"), ("_x.txt", "x.txt"), ("Zed_a.txt", "Zed_a.txt"), ("@@@", "uploaded_doc")):
        assert value(spark, T.sanitized_name(F.lit(name))) == safe
    for url, name in (("http://a/b/c.txt?x=/1", "c.txt"), ("http://a/", "remote_file")):
        assert value(spark, T.url_file_name(F.lit(url))) == name
    assert len(T.QUERY_STOP_WORDS) == 81
    assert len(T.TOKEN_STOP_WORDS) == 57


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\x0bc\x1cd e\n\n", "\n", "x\x85y"])
def test_lines(spark, text):
    assert value(spark, T.lines(F.lit(text))) == text.splitlines()


def test_truncation_marker(spark):
    long = "\n".join(["line"] * 51)
    docs = spark.createDataFrame([(1, "b.md", long), (2, "a.md", "of a"), (3, "c.md", "")], "doc_id long, display_name string, content string")
    assert [(r.doc_id, r.score) for r in keyword.top_documents(docs, "truncated").collect()] == [(1, 2), (2, 0)]
    assert [r.display_name for r in keyword.top_documents(docs, "of a").collect()] == ["a.md", "b.md"]


def test_headings_and_packing(spark):
    text = "intro\n# H one\nbody\n====\nmore"
    assert value(spark, chunking.heading_parts(F.lit(text))) == ["intro\n", "# H one", "\nbody\n", "====", "\nmore"]
    docs = spark.createDataFrame([(1, "a" * 30 + "\n# H\n" + "b" * 30), (2, ""), (3, None), (4, "x" * 40 + "\n\n" + "y" * 40)], "doc_id long, content string")
    got = {(r.doc_id, r.chunk_ix): (r.text, r.approx_offset) for r in chunking.chunks(docs, 34).collect()}
    assert got == {(1, 0): ("a" * 30 + "\n\n# H", 0), (1, 1): ("\n" + "b" * 30, 36), (4, 0): ("x" * 40, 0), (4, 1): ("y" * 40, 41)}


def test_tfidf_and_relevance(spark):
    chunked = spark.createDataFrame([(1, 0, "dragon fire"), (1, 1, "dragon ice")], "doc_id long, chunk_ix int, text string")
    got = {(r.chunk_ix, r.term): round(r.weight, 6) for r in chunking.tfidf(chunked).collect()}
    assert got == {(0, "dragon"): 0.5, (0, "fire"): 0.702733, (1, "dragon"): 0.5, (1, "ice"): 0.702733}
    index = spark.createDataFrame([(1, 0, ["dragon", "fire"], {"dragon": 0.5, "fire": 0.702733}), (1, 1, ["x1"], {})], "doc_id long, chunk_ix int, tokens array<string>, tfidf map<string,double>")
    assert [round(r.score, 6) for r in relevance.relevant_chunks(index, "dragon fire").collect()] == [2.345329]
    assert [round(r.score, 6) for r in relevance.relevant_chunks(index, "x1 x1").collect()] == [1.2]
    assert relevance.relevant_chunks(index, "the of").count() == 0


def test_cosine(spark):
    for a, b, c in (([1.0, 2.0], [2.0, 1.0], 0.8), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0)):
        lists = [F.array(*map(F.lit, v)) for v in (a, b)]
        assert value(spark, vectors.cosine(*lists)) == pytest.approx(c)


def test_history(spark):
    rows = [(1, 1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(60)]
    messages = spark.createDataFrame(rows, "guild_id long, channel_id long, turn long, role string, content string")
    keys = ["guild_id", "channel_id"]
    assert sorted(r.turn for r in history.prompt_history(messages, 2, keys).collect()) == [56, 57, 58, 59]
    assert history.prompt_history(messages, 0, keys).count() == 0
    assert history.retained(messages, 0, keys).count() == 50
    assert history.transcript(messages, keys, 2).first()["transcript"] == "User: m58\nAI: m59"


def test_splitting(spark):
    assert splitting.split_message("a" * 1000 + "\n\n" + "b" * 1000, "--- C ---") == ["--- C ---\n" + c * 1000 for c in "ab"]
    assert splitting.split_message("x" * 1901) == ["x" * 1901]
    assert splitting.split_message("x" * 1895) == ["x" * 1895]
    assert splitting.split_message("") == [""]
    rows = spark.createDataFrame([(1, "a" * 1901), (2, ""), (3, None)], "id long, text string")
    assert sorted((r.id, r.part, len(r.text)) for r in splitting.fixed_width_parts(rows, ["id"]).collect()) == [(1, 1, 1900), (1, 2, 1), (2, 1, 0), (3, 1, 0)]
    assert sorted((r.id, r.part, r.parts) for r in splitting.message_parts(rows, ["id"]).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_reminders(spark):
    rows = spark.createDataFrame([(10, "seconds"), (5, "days"), (5, "seconds"), (2, "minutes"), (1, "Hour")], "n int, unit string")
    assert sorted(r.delay for r in reminders.valid(rows).collect()) == [10, 120, 3600]


def test_personas(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"default": "assistant", "characters": {"system": {"model": "", "system_prompt": "Be helpful."}, "assistant": {"display": "Helper", "model": "m"}, "dark_elf": {}}}))
    known = personas.load_personas(spark, str(path))
    assert {r.key: (r.display, r.is_default) for r in known.collect()} == {"system": ("System", False), "assistant": ("Helper", True), "dark_elf": ("Dark_Elf", False)}
    asked = spark.createDataFrame([("system",), ("HELPER",), ("none",)], "asked string")
    assert {r.asked: r.persona_key for r in personas.resolve(asked, known).collect()} == {"system": "system", "HELPER": "assistant", "none": None}
    (tmp_path / "bad.json").write_text("not json")
    for name in ("bad.json", "missing.json"):
        assert [(r.key, r.display, r.is_default) for r in personas.load_personas(spark, str(tmp_path / name)).collect()] == [("default", "Default", True)]
    (tmp_path / "same.json").write_text(json.dumps({"characters": {"z": {"display": "Bo"}, "a": {"display": "Bo"}, "b": {"display": "BO"}}}))
    same = personas.load_personas(spark, str(tmp_path / "same.json"))
    asked = spark.createDataFrame([("bo",), ("z",)], "asked string")
    assert {r.asked: r.persona_key for r in personas.resolve(asked, same).collect()} == {"bo": "a", "z": "z"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "1_a.txt").write_bytes(b"Test \xff document.\nLine 2")
    (tmp_path / "sub/nested.md").write_text("# Nested")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "none").mkdir()
    (tmp_path / "image.png").write_bytes(b"123")
    root = str(tmp_path)
    assert {r.display_name: r.content for r in files.read_documents(spark, root).collect()} == {"_a.txt": "Test � document.\nLine 2", "nested.md": "# Nested"}
    assert [(r.name, r.size) for r in files.catalogue(spark, root).collect()] == [("1_a.txt", 23), ("empty.txt", 0), ("image.png", 3), ("sub/nested.md", 8)]
    assert [r.name for r in files.root_directories(spark, root).collect()] == ["none", "sub"]
    assert files.read_documents(spark, str(tmp_path / "missing")).count() == 0
    uploads = spark.createDataFrame([("a.txt", b"1", None), ("a.txt", b"2", None), ("b.md", b"3", "../x"), (None, b"4", "s")], "filename string, content binary, subfolder string")
    got = [(r.target, r.error) for r in files.validated_uploads(uploads).orderBy("content").collect()]
    assert got[2:] == [(None, "bad subfolder"), ("s/attachment.txt", None)]
    assert len({t for t, _ in got[:2]}) == 2
    (tmp_path / "b.tXt").write_text("any case")
    assert files.read_documents(spark, root).filter("display_name = 'b.tXt'").count() == 1
    copies = spark.createDataFrame([("a.txt", b"1", None), ("a.txt", b"1", None), ("a.txt", b"2", "s"), ("c.txt", b"5", None)], "filename string, content binary, subfolder string")
    stored = spark.createDataFrame([("c.txt",)], "name string")
    accepted = files.validated_uploads(copies, stored=stored)
    kept = files.store_uploads(accepted, str(tmp_path / "up")).collect()
    assert len({r.name for r in kept}) == 4
    assert {"a.txt", "s/a.txt"} < {r.name for r in kept}
    assert "c.txt" not in {r.name for r in kept}
    assert {r.name: (tmp_path / "up" / r.name).stat().st_size for r in kept} == {r.name: r.size for r in kept}
    assert files.reindex(spark, root, str(tmp_path / "index")) == len([p for p in tmp_path.rglob("*") if p.is_file() and "index" not in p.parts])
    docs = files.read_documents(spark, root).filter("display_name IN ('_a.txt', 'nested.md')").select(F.col("display_name").alias("doc_id"), "content")
    assert files.write_chunks(docs, str(tmp_path / "out")) == 2


def test_retrieve(spark):
    docs = spark.createDataFrame([(1, "p/a", "a.md", "fire and ice"), (2, "p/b", "b.md", "fire fire")], "doc_id long, path string, display_name string, content string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    ids = lambda df: [r.doc_id for r in df.collect()]
    assert ids(retrieve(docs, "fire")) == ids(retrieve(docs, "fire", "unknown")) == ids(retrieve(docs, "fire", "vector")) == [2, 1]
    assert ids(retrieve(docs, "fire", "vector", embeddings=vecs, query_vector=[0.9, 0.1])) == [1, 2]
    assert ids(retrieve(docs, " ", "vector", embeddings=vecs, query_vector=[1.0, 0.0])) == []
    assert ids(retrieve(docs, "ice", "chunk")) == [1]


def test_one_exchange_of_tfidf(spark):
    """A hash by document serves counts and windows."""
    chunked = spark.createDataFrame([(1, 0, "dragon fire")], "doc_id long, chunk_ix int, text string")
    plan = chunking.tfidf(chunked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_numbers_and_sentinels(spark):
    for raw, found in (("10", 10), (" +1_0 ", 10), ("1__0", 3), ("", 3), (None, 3), ("x", 3), ("-4", -4)):
        assert value(spark, T.safe_int(F.lit(raw).cast("string"), 3)) == found
    for raw, found in ((" CLEAR\n", "clear"), ("clear it", None), ("", None), (None, None)):
        assert value(spark, T.or_clear(F.lit(raw).cast("string"))) == found


def test_model_fallback(spark):
    def fails(prompt):
        raise ValueError(prompt)

    rows = spark.createDataFrame([(1, "x")], "id long, prompt string")
    assert apply_model(rows, [fails, lambda p: p.upper()]).first()["reply"] == "X"


def test_parts_leave_in_slices(spark, monkeypatch):
    monkeypatch.setattr(splitting, "SLICE", 3)
    rows = spark.range(10).select("id", F.repeat(F.lit("word "), (F.col("id") * 100).cast("int")).alias("text")).coalesce(1)
    got = splitting.message_parts(rows, ["id"]).groupBy("id").agg(F.max("part").alias("n")).collect()
    assert {r.id: r.n for r in got} == {k: len(splitting.split_message("word " * 100 * k)) for k in range(10)}


def test_tasks_follow_the_text(spark, monkeypatch):
    """What a task counts is bounded: twice the text goes to twice the tasks, which adaptive execution doesn't join again."""
    monkeypatch.setattr(chunking, "TASK_CHARS", 50)
    for n in (20, 40):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("chunk_ix"), F.lit("dragon fire ice kings and").alias("text"))
        assert chunking.tasks_of(rows) == n // 2
        assert chunking.tfidf(rows).rdd.getNumPartitions() == chunking.token_counts(rows).rdd.getNumPartitions() == n // 2
        assert chunking.indexed(rows).filter(F.size("tfidf") == 4).count() == n
