"""Streams of conversation events: bounded history for each channel, clearing it, the latest persona, due reminders.

State is a list or a map of values a key, held by the RocksDB state store (``use_state_store``), and timers of the state
store wake reminders, so a batch reads and writes only the keys that it touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLEAR = "clear"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that lists, maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _History(StatefulProcessor):
    """A channel's messages as list state: appended to, and cut to the last ``most`` once it is twice as long."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("messages", "role string, content string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")  # a channel's events of a batch
        messages = list(zip(new["role"], new["content"], strict=True))
        cleared = [k for k, (role, _) in enumerate(messages) if role == CLEAR]
        if cleared:
            self.held.clear()
            messages = messages[cleared[-1] + 1 :]
        before = list(self.held.get()) if self.held.exists() else []
        every = [*map(tuple, before), *messages]
        if len(every) > 2 * self.most:
            self.held.put(every[-self.most :])
        elif messages:
            self.held.appendList(messages)
        shown = json.dumps([{"role": r, "content": c} for r, c in every[-self.most :]], ensure_ascii=False)
        yield pd.DataFrame({"guild_id": [key[0]], "channel_id": [key[1]], "kept": [min(len(every), self.most)], "history": [shown]})

    def close(self) -> None:
        pass


def bounded_history(events: DataFrame, rounds: int = 10) -> DataFrame:
    """guild_id, channel_id, kept (number), history (JSON of role and content) after each batch of events.

    events: guild_id, channel_id, turn, role, content; the role ``clear`` empties the channel. A channel shows its last
    2 x rounds messages, or 50 for 0 rounds, and its state holds twice as many at most.
    """
    use_state_store(events.sparkSession)
    kinds = "guild_id long, channel_id long, kept long, history string"
    return events.groupBy("guild_id", "channel_id").transformWithStateInPandas(_History(2 * rounds if rounds else 50), kinds, "update", "none")


def latest_persona(choices: DataFrame) -> DataFrame:
    """guild_id, channel_id, key: the persona chosen last in each channel, of choices (guild_id, channel_id, seq, key)."""
    return choices.groupBy("guild_id", "channel_id").agg(F.max_by("key", "seq").alias("key"))


class _Reminders(StatefulProcessor):
    """Messages by the time they are due, with a timer for each time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due long, nth long", "message string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for message, delay in zip(batch["message"], batch["delay"], strict=True):
                due, nth = now + int(delay) * 1000, 0
                while self.waiting.containsKey((due, nth)):
                    nth += 1
                self.waiting.updateValue((due, nth), (message,))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, nth, messages = expiredTimerInfo.getExpiryTimeInMs(), 0, []
        while self.waiting.containsKey((due, nth)):
            messages.append(self.waiting.getValue((due, nth))[0])
            self.waiting.removeKey((due, nth))
            nth += 1
        if messages:
            yield pd.DataFrame({"id": [key[0]] * len(messages), "message": messages})

    def close(self) -> None:
        pass


def due_reminders(reminders: DataFrame) -> DataFrame:
    """One row for each reminder (id, message, delay in seconds) once its delay of processing time has passed.

    An id may have several. A null delay, or one that isn't above 0, gives no reminder.
    """
    use_state_store(reminders.sparkSession)
    usable = reminders.filter(F.col("delay") > 0)
    return usable.groupBy("id").transformWithStateInPandas(_Reminders(), "id long, message string", "append", "processingTime")
