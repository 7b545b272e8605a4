"""The other commands as dataflows over many channels: summaries, translations, text of images, personas.

Each prepares prompts (JSON of model and messages) or an error a row, asks the model, and cuts replies for sending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import history, personas, splitting
from .model import apply_model

MOST_FETCHED = 32_000
# What the commands ask of the model, and what stands before their replies.
OCR_TASK = "Extract all text from this image accurately."
NOTHING_TO_SUMMARIZE, NO_SUMMARY = "⚠️ Nothing to summarize.", "⚠️ Failed to generate summary after trying multiple models."
NO_TEXT = "⚠️ No text to translate.  Provide text as ``/translate Spanish: Hello world``."
EMPTY = {"summary": "(empty)", "translation": "(translation failed)", "ocr": "(no text found)"}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_json(model: str, *messages: Column) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(*messages).alias("messages")))


def summary_prompts(asked: DataFrame, messages: DataFrame, keys: list[str], model: str, most: int = 30) -> DataFrame:
    """asked (keys, url, body) with source, prompt, error, without the body: its first characters, or the channel's last messages.

    A null url asks for the conversation. messages: keys, turn, role, content.
    """
    line = F.concat(F.lit("["), T.role_label(F.col("role")), F.lit("]: "), F.col("content"))
    last = history.last_messages(messages, most, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("_lines"))  # ``most`` rows
    rows = asked.join(last, keys, "left")
    talk = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n\n")
    text = F.when(F.col("url").isNotNull(), F.substring("body", 1, MOST_FETCHED)).otherwise(talk)
    source = F.when(F.col("url").isNotNull(), F.concat(F.lit("file from `"), F.substring("url", 1, 80), F.lit("...`"))).otherwise("recent conversation")
    rows = rows.withColumns({"source": source, "_text": F.coalesce(text, F.lit(""))}).withColumn("error", F.when(T.is_blank(F.col("_text")), NOTHING_TO_SUMMARIZE))
    task = F.concat(F.lit("Summarize the following text from "), "source", F.lit(". Be concise but complete."))
    prompt = F.when(F.col("error").isNull(), prompt_json(model, message("system", task), message("user", F.col("_text"))))
    return rows.withColumn("prompt", prompt).drop("_lines", "_text", "body")


def translation_prompts(asked: DataFrame, messages: DataFrame, keys: list[str], model: str) -> DataFrame:
    """asked (keys, target_language, source_language) with target, prompt, error: the given text, or the last user message."""
    target, given = T.target_and_text(F.col("target_language"))
    rows = asked.withColumns({"target": target, "_given": F.nullif(given, F.lit(""))}).join(history.last_user_message(messages, keys), keys, "left")
    rows = rows.withColumn("_text", F.coalesce("_given", F.nullif("last_user_message", F.lit(""))))
    rows = rows.withColumn("error", F.when(F.col("_text").isNull(), NO_TEXT))
    clause = F.when(F.coalesce("source_language", F.lit("")) != "", F.concat(F.lit(" from "), "source_language")).otherwise("")
    task = F.concat(F.lit("Translate"), clause, F.lit(" text into "), "target", F.lit(". Return ONLY translated text."))
    prompt = F.when(F.col("error").isNull(), prompt_json(model, message("system", task), message("user", F.col("_text"))))
    return rows.withColumn("prompt", prompt).drop("_given", "_text", "last_user_message")


def ocr_prompts(images: DataFrame, model: str) -> DataFrame:
    """images (filename, content) with prompt, error: the task and the image as a data URI."""
    uri = T.data_uri(F.coalesce("filename", F.lit("")), F.col("content"))
    task = F.struct(F.lit("text").alias("type"), F.lit(OCR_TASK).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
    image = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(uri.alias("url")).alias("image_url"))
    prompt = prompt_json(model, message("user", F.array(task, image)))
    missing = F.col("content").isNull()
    return images.withColumns({"prompt": F.when(~missing, prompt), "error": F.when(missing, "⚠️ Please attach an image.")})


def answered(rows: DataFrame, calls: list[Callable[[str], str]], kind: str, failure: str | None = None, timeout: float = 120, concurrency: int = 8) -> DataFrame:
    """rows (prompt, error) with reply; ``error`` is the row's own, or ``failure`` (else the call's) if no call answered."""
    found = apply_model(rows.withColumnRenamed("error", "_error"), calls, errors="_failure", timeout=timeout, concurrency=concurrency, empty=EMPTY[kind])
    own = F.col("_failure") if failure is None else F.when(F.col("_failure").isNotNull(), failure)
    return found.withColumn("error", F.coalesce("_error", F.when(F.col("reply").isNull(), own))).drop("_error", "_failure", "prompt")


def titled_parts(rows: DataFrame, keys: list[str], whole: Column, part: Callable[[Column], Column], width: int = splitting.LIMIT) -> DataFrame:
    """keys, part (from 1), parts, text: replies in slices under a title; errors as they are."""
    cut = rows.select(*keys, "error", whole.alias("_whole"), *(c for c in ("source", "target") if c in rows.columns), F.when(F.col("error").isNull(), T.fixed_parts(F.col("reply"), width)).otherwise(F.array("error")).alias("_all"))
    each = cut.select("*", F.size("_all").cast("long").alias("parts"), F.posexplode("_all").alias("_at", "_text"))
    each = each.withColumn("part", (F.col("_at") + 1).cast("long"))
    title = F.when(F.col("error").isNotNull(), "").when(F.col("parts") == 1, F.col("_whole")).otherwise(part(F.col("part").cast("string")))
    return each.select(*keys, "part", "parts", F.concat(title, "_text").alias("text"))


def summary_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    title = lambda more: F.concat(F.lit("\U0001f4dd **Summary** ("), "source", F.lit(")"), more, F.lit(":\n\n"))
    return titled_parts(rows, keys, title(F.lit("")), lambda k: title(F.concat(F.lit(" (part "), k, F.lit(")"))))


def translation_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    title = lambda more: F.concat(F.lit("\U0001f310 Translated to **"), "target", F.lit("**"), more)
    return titled_parts(rows, keys, title(F.lit(":\n\n")), lambda k: title(F.concat(F.lit(" (part "), k, F.lit(")\n\n"))))


def ocr_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return titled_parts(rows, keys, F.lit("\U0001f50d Extracted text:\n\n"), lambda k: F.concat(F.lit("\U0001f50d OCR (part "), k, F.lit(")\n\n")))


def persona_commands(asked: DataFrame, choices: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replies (keys, seq, text) to asked persona commands (keys, seq, action, name), and the choices that they add (keys, seq, key).

    A command sees the channel's last choice before it, of ``choices`` (keys, seq, key) and of earlier commands. Persona
    files are small, so the list of all is one value.
    """
    default = known.filter("is_default").select("key").first()["key"]
    named = personas.resolve(asked, known, "name")
    set_ = (F.col("action") == "set") & F.col("persona_key").isNotNull()
    chosen = F.when(set_, F.col("persona_key")).when(F.col("action") == "reset", F.lit(default))
    added = named.filter(chosen.isNotNull()).select(*keys, "seq", chosen.alias("key"))
    every = named.withColumns({"_chosen": chosen, "_asked": F.lit(True)}).unionByName(choices.select(*keys, "seq", F.col("key").alias("_chosen")), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = every.withColumn("_active", F.coalesce(F.last("_chosen", ignorenulls=True).over(before), F.lit(default))).filter("_asked")
    shown = F.struct("at", "key", "display", "model")
    listed = known.agg(F.sort_array(F.collect_list(shown)).alias("_known"))
    rows = rows.crossJoin(F.broadcast(listed))  # one row
    of = lambda key: F.element_at(F.filter("_known", lambda p: p["key"] == key), 1)
    current, wanted, fallback = (of(F.coalesce(c, F.lit(default))) for c in (F.col("_active"), F.col("persona_key"), F.lit(default)))
    lines = F.transform("_known", lambda p: F.concat(F.lit("  • `"), p["key"], F.lit("` — display: `"), F.coalesce(F.nullif(p["display"], F.lit("")), p["key"]), F.lit("`"), F.when(p["key"] == F.col("_active"), " ← current").otherwise("")))
    model = lambda p: F.coalesce(F.nullif(p["model"], F.lit("")), F.lit("(none set)"))
    names = F.array_join(F.transform("_known", lambda p: F.concat(F.lit("`"), p["key"], F.lit("`"))), ", ")
    text = (
        F.when(F.col("action") == "list", F.concat(F.lit("**Available characters:**\n\n"), F.array_join(lines, "\n")))
        .when((F.col("action") == "set") & F.col("name").isNull(), "Please provide a character key: `/character set <name>`")
        .when(set_, F.concat(F.lit("Switched to **"), wanted["display"], F.lit("** (model: ``"), model(wanted), F.lit("``)")))
        .when(F.col("action") == "set", F.concat(F.lit("Unknown character ``"), "name", F.lit("``. Available: "), names))
        .when(F.col("action") == "show", F.concat(F.lit("**Current character:** `"), current["display"], F.lit("`\n**Model:** ``"), current["model"], F.lit("``")))
        .when(F.col("action") == "reset", F.concat(F.lit("Reverted to default character: **"), fallback["display"], F.lit("**")))
        .otherwise(F.concat(F.lit("Unknown action ``"), F.coalesce("action", F.lit("")), F.lit("``. Use: list, set, show, reset.")))
    )
    return rows.select(*keys, "seq", text.alias("text")), added
