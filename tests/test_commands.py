"""The commands as dataflows: summaries, translations, text of images, personas."""

import json

from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.plans import commands

MESSAGES = "guild long, channel long, turn long, role string, content string"
KEYS = ["guild", "channel"]


def echoing():
    """A stand-in for a model; workers don't have this module, so it is a function of its own."""

    def echo(prompt):
        import json

        return json.loads(prompt)["messages"][-1]["content"]

    return echo


def texts(parts):
    return {(r.guild, r.channel, r.part): r.text for r in parts.collect()}


def test_summaries(spark):
    rows = [(1, 1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(40)] + [(1, 2, 0, "tool", "x")]
    messages = spark.createDataFrame(rows, MESSAGES)
    asked = spark.createDataFrame([(1, 1, None, None), (1, 2, None, None), (1, 3, None, None), (2, 1, "http://a/" + "b" * 90, "c" * 40_000), (2, 2, "http://e/", None)], "guild long, channel long, url string, body string")
    prompts = commands.summary_prompts(asked, messages, KEYS, "m")
    assert prompts.filter("guild = 1 AND channel = 1").first().prompt.startswith('{"model":"m","messages":[{"role":"system","content":"Summarize the following text from recent conversation. Be concise but complete."}')
    got = texts(commands.summary_parts(commands.answered(prompts, [echoing()], "summary"), KEYS))
    lines = "\n\n".join(f"[{'User' if t % 2 == 0 else 'AI'}]: m{t}" for t in range(10, 40))
    assert got[1, 1, 1] == "\U0001f4dd **Summary** (recent conversation):\n\n" + lines
    assert got[1, 2, 1].endswith("[tool]: x")
    assert got[1, 3, 1] == got[2, 2, 1] == commands.NOTHING_TO_SUMMARIZE
    parts = sorted(k[2] for k in got if k[:2] == (2, 1))
    assert parts == list(range(1, 18))  # 32,000 characters in slices of 1,900
    title = f"\U0001f4dd **Summary** (file from `http://a/{'b' * 71}...`) (part 17):\n\n"
    assert got[2, 1, 17] == title + "c" * (32_000 - 16 * 1900)


def test_summary_fallbacks(spark):
    def fails(prompt):
        raise OSError("down")

    asked = spark.createDataFrame([(1, 1, "u", "text")], "guild long, channel long, url string, body string")
    prompts = commands.summary_prompts(asked, spark.createDataFrame([], MESSAGES), KEYS, "m")
    reply = lambda calls: texts(commands.summary_parts(commands.answered(prompts, calls, "summary", commands.NO_SUMMARY), KEYS))[1, 1, 1]
    assert reply([fails, echoing()]).endswith("\n\ntext")
    assert reply([fails, fails]) == commands.NO_SUMMARY
    assert reply([lambda p: ""]).endswith("(empty)")


def test_translations(spark):
    messages = spark.createDataFrame([(1, 1, 0, "user", "first"), (1, 1, 1, "user", "last"), (1, 1, 2, "assistant", "no")], MESSAGES)
    asked = spark.createDataFrame([(1, 1, "Spanish", None), (1, 2, " Spanish : Hello: world ", "English"), (1, 3, "Spanish", ""), (1, 4, "Spanish:  ", None)], "guild long, channel long, target_language string, source_language string")
    prompts = commands.translation_prompts(asked, messages, KEYS, "m")
    systems = {r.channel: json.loads(r.prompt)["messages"][0]["content"] for r in prompts.collect() if r.prompt}
    assert systems == {1: "Translate text into Spanish. Return ONLY translated text.", 2: "Translate from English text into Spanish. Return ONLY translated text."}
    got = texts(commands.translation_parts(commands.answered(prompts, [echoing()], "translation"), KEYS))
    title = "\U0001f310 Translated to **Spanish**:\n\n"
    assert got == {(1, 1, 1): title + "last", (1, 2, 1): title + "Hello: world", (1, 3, 1): commands.NO_TEXT, (1, 4, 1): commands.NO_TEXT}


def test_text_of_images(spark):
    images = spark.createDataFrame([(1, 1, "A.JPG", b"123"), (1, 2, None, b""), (1, 3, "x.png", None)], "guild long, channel long, filename string, content binary")
    prompts = commands.ocr_prompts(images, "vision")
    content = {r.channel: json.loads(r.prompt)["messages"][0]["content"] for r in prompts.collect() if r.prompt}
    assert content[1] == [{"type": "text", "text": commands.OCR_TASK}, {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64,MTIz"}}]
    got = texts(commands.ocr_parts(commands.answered(prompts, [lambda p: "y" * 1901], "ocr"), KEYS))
    assert got[1, 1, 1] == "\U0001f50d OCR (part 1)\n\n" + "y" * 1900
    assert got[1, 2, 2] == "\U0001f50d OCR (part 2)\n\ny"
    assert got[1, 3, 1] == "⚠️ Please attach an image."


def test_personas(spark):
    known = spark.createDataFrame([(0, "sys", "System", "", True), (1, "elf", "", "m", False)], "at int, key string, display string, model string, is_default boolean")
    choices = spark.createDataFrame([(1, 2, 0, "elf")], "guild long, channel long, seq long, key string")
    rows = [(1, 1, 1, "list", None), (1, 1, 2, "set", "elf"), (1, 1, 3, "show", None), (1, 1, 4, "set", "orc"), (1, 1, 5, "set", None), (1, 1, 6, "reset", None), (1, 1, 7, "show", None), (1, 1, 8, "fly", None), (1, 2, 1, "show", None)]
    asked = spark.createDataFrame(rows, "guild long, channel long, seq long, action string, name string")
    replies, added = commands.persona_commands(asked, choices, known, KEYS)
    got = {(r.channel, r.seq): r.text for r in replies.collect()}
    assert got[1, 1] == "**Available characters:**\n\n  • `sys` — display: `System` ← current\n  • `elf` — display: `elf`"
    assert got[1, 2] == "Switched to **** (model: ``m``)"
    assert got[1, 3] == got[2, 1] == "**Current character:** ``\n**Model:** ``m``"
    assert got[1, 4] == "Unknown character ``orc``. Available: `sys`, `elf`"
    assert got[1, 5].startswith("Please provide a character key")
    assert got[1, 6] == "Reverted to default character: **System**"
    assert got[1, 7] == "**Current character:** `System`\n**Model:** ````"
    assert got[1, 8] == "Unknown action ``fly``. Use: list, set, show, reset."
    assert sorted((r.channel, r.seq, r.key) for r in added.collect()) == [(1, 2, "elf"), (1, 6, "sys")]


def test_tokens_are_counted_after_one_exchange(spark):
    chunked = spark.createDataFrame([(1, 0, "dragon fire dragon"), (1, 1, ""), (1, 2, None)], "doc_id long, chunk_ix int, text string")
    counts = chunking.token_counts(chunked)
    assert {(r.chunk_ix, r.term, r.n, r["size"]) for r in counts.collect()} == {(0, "dragon", 2, 3), (0, "fire", 1, 3)}
    assert counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") <= 2
    assert counts.groupBy(F.lit(1)).count().first()["count"] == 2


def test_fetched_bodies_stay_out_of_the_calls(spark):
    """A body goes to the model's tasks in its prompt only, not once more beside it."""
    asked = spark.createDataFrame([(1, "u", "text")], "channel long, url string, body string")
    none = spark.createDataFrame([], "channel long, turn long, role string, content string")
    rows = commands.summary_prompts(asked, none, ["channel"], "m")
    assert "body" not in rows.columns
    assert "text" in rows.first()["prompt"]
