"""State with lists and timers: bounds, clearing, restarts from a checkpoint."""

import json
import time

from quarry.streaming.conversation import bounded_history, due_reminders, latest_persona

EVENTS = "guild_id long, channel_id long, turn long, role string, content string"
REMINDERS = "id long, message string, delay long"


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def start(df, mode, name, path, **trigger):
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(**trigger).start()


def sunk(df, path, **trigger):
    """A stream to files, which restarts can go on with."""
    return df.writeStream.outputMode("append").format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).trigger(**trigger).start()


def test_bounded_history_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    add(spark, [(1, 1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(3)] + [(1, 2, 0, "user", "d"), (1, 2, 1, "clear", ""), (2, 1, 0, "user", "é")], EVENTS, source)
    events = spark.readStream.schema(EVENTS).parquet(str(source))
    got: dict = {}

    def keep(batch, _):
        got.update({(r.guild_id, r.channel_id): [m["content"] for m in json.loads(r.history)] for r in batch.collect()})

    def run():
        got.clear()
        query = bounded_history(events, 2).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return dict(got)

    assert run() == {(1, 1): ["m0", "m1", "m2"], (1, 2): [], (2, 1): ["é"]}
    add(spark, [(1, 1, t, "user", f"m{t}") for t in range(3, 15)], EVENTS, source)  # over twice the bound
    assert run() == {(1, 1): ["m11", "m12", "m13", "m14"]}
    add(spark, [(1, 1, 15, "user", "m15"), (1, 2, 2, "user", "again"), (2, 1, 1, "clear", None)], EVENTS, source)
    assert run() == {(1, 1): ["m12", "m13", "m14", "m15"], (1, 2): ["again"], (2, 1): []}


def test_reminders_over_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    add(spark, [(1, "soon", 2), (1, "soon too", 2), (2, "late", 3600), (3, "never", 0), (4, "never", None), (5, "later", 8)], REMINDERS, source)
    rows = spark.readStream.schema(REMINDERS).parquet(str(source))

    def until(n):
        query = sunk(due_reminders(rows), tmp_path, processingTime="1 second")
        try:
            for _ in range(120):
                time.sleep(0.5)
                found = sorted((r.id, r.message) for r in spark.read.schema("id long, message string").parquet(str(tmp_path / "out")).collect()) if list((tmp_path / "out").glob("*.parquet")) else []
                if len(found) >= n or query.exception():
                    break
            assert query.exception() is None
        finally:
            query.stop()
        return found

    assert until(2)[:2] == [(1, "soon"), (1, "soon too")]
    assert until(3) == [(1, "soon"), (1, "soon too"), (5, "later")]


def test_latest_persona_stream(spark, tmp_path):
    schema = "guild_id long, channel_id long, seq long, key string"
    add(spark, [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c")], schema, tmp_path / "in")
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = start(latest_persona(rows), "complete", "personas", tmp_path / "cp", availableNow=True)
    query.awaitTermination(60)
    assert {(r.guild_id, r.channel_id): r.key for r in spark.table("personas").collect()} == {(1, 1): "b", (1, 2): "c"}
