"""Typed settings from a table of names and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Whole-number settings and their defaults.
NUMBERS = {"CONTEXT_WINDOW": 10, "AI_REQUEST_TIMEOUT": 120, "MAX_TOKENS": 2000, "CHUNK_SIZE": 2000, "RAG_MAX_DOCS": 10}
# Text settings and their defaults.
TEXTS = {"BOT_PREFIX": "!ai", "RAG_RETRIEVAL_METHOD": "keyword", "KB_PATH": "data/knowledge", "KB_DEFAULT_KB": "kb", "MODEL_NAME": None}


def typed_settings(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Typed settings from rows (name, value), a row for each of the ``keys`` (one in all without); an unknown, null or unusable value gives the default.

    CHAT_HISTORY_RESET is ``clear`` or null; the retrieval method and the knowledge base's name are in small letters.
    MODEL_NAME is null by default. Of a repeated name the largest counts.
    """
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    numbers = [T.safe_int(of(n), d).alias(n.lower()) for n, d in NUMBERS.items()]
    texts = [F.coalesce(of(n), F.lit(d)).alias(n.lower()) for n, d in TEXTS.items()]
    found = rows.groupBy(*(keys or [])).agg(*numbers, *texts, T.or_clear(of("CHAT_HISTORY_RESET")).alias("chat_history_reset"))
    return found.withColumns({n: F.lower(n) for n in ("rag_retrieval_method", "kb_default_kb")})
