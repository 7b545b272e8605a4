"""Reminders: units, validation, due rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_SECONDS = 10


def delay_seconds(n: Column, unit: Column) -> Column:
    """Seconds of n units; null for an unknown unit."""
    return n.cast("long") * F.try_element_at(T.mapping(T.UNIT_SECONDS), F.lower(unit)).cast("long")


def valid(reminders: DataFrame) -> DataFrame:
    """Reminders (n, unit) of a known unit and at least ten seconds, with delay."""
    return reminders.withColumn("delay", delay_seconds(F.col("n"), F.col("unit"))).filter(F.col("delay") >= LEAST_SECONDS)


def due(reminders: DataFrame, as_of: Column, asked_at: str = "ts") -> DataFrame:
    """Valid reminders that are due by ``as_of``, with due_at."""
    at = F.col(asked_at) + F.make_dt_interval(secs=F.col("delay").cast("decimal(18,6)"))
    return valid(reminders).withColumn("due_at", at).filter(F.col("due_at") <= as_of)
