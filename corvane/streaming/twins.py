"""Streams over event files. Each query has a batch twin in ``operators.sessions`` with the same result on the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as P

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its time is made a timestamp, which watermarks need."""
    folder, name = sf_dir, "events.parquet"
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def session_stats(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return P.session_stats(events, kinds=kinds)


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events of each kind in tumbling windows, with a watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Process what is there and end; in complete mode each batch replaces the table. Returns the table."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/table")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def resumed(rows: DataFrame, skip: str, path: str, schema: str) -> DataFrame:
    """Exactly-once processing of a folder that grows between two runs with one checkpoint; rows to skip are left out."""
    spark = rows.sparkSession
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in").where(f"not ({skip})")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


# --- reducers ---
#: A reducer takes a state and an event and returns the next state.
START = {"status": "idle", "user_turns": 0, "messages": 0, "open": False, "error": None}


def dialogue(state: dict[str, Any], kind: str) -> dict[str, Any]:
    """States idle, booting, streaming; an error drops the answer that is being written."""
    s = dict(state)
    if kind == "reset":
        return dict(START)
    if kind == "booting":
        s |= {"status": "booting", "error": None}
    elif kind == "user":
        s |= {"user_turns": s["user_turns"] + 1, "messages": s["messages"] + 1, "error": None}
    elif kind == "start":
        s |= {"status": "streaming", "messages": s["messages"] + 1, "open": True}
    elif kind == "done":
        s |= {"status": "idle", "open": False}
    elif kind == "error":
        s |= {"status": "idle", "messages": s["messages"] - int(s["open"]), "open": False, "error": "error"}
    return s


def panel(state: dict[str, Any], kind: str, screen: str | None = None) -> dict[str, Any]:
    """The commentary panel: a dialogue whose history starts anew when the screen changes."""
    if screen is not None and screen != state.get("screen"):
        state = START | {"screen": screen}
    return dialogue(state, kind) | {"screen": state.get("screen")}


STATE = "status string, user_turns int, messages int, open boolean, error string"


def _replay(rows: pd.DataFrame, key: str, order: str) -> dict[str, Any]:
    state = dict(START)
    for role in rows.sort_values(order)["role"]:
        for kind in ("user",) if role == "user" else ("start", "done") if role == "assistant" else ("booting", "done"):
            state = dialogue(state, kind)
    return state


def dialogue_states(messages: DataFrame, key: str, order: str) -> DataFrame:
    """The state after each conversation's messages, by replay of its events."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0], **_replay(pdf, key, order)}])

    return messages.select(key, order, "role").groupBy(key).applyInPandas(run, f"{key} long, {STATE}")


def dialogue_stream(messages: DataFrame, key: str, order: str) -> DataFrame:
    """The streaming form: the state of a conversation is kept between batches and given out whenever it changes."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(START, state.get)) if state.exists else dict(START)
        for pdf in batches:
            for role in pdf.sort_values(order)["role"]:
                for kind in ("user",) if role == "user" else ("start", "done") if role == "assistant" else ("booting", "done"):
                    now = dialogue(now, kind)
        state.update(tuple(now.values()))
        yield pd.DataFrame([{key: k[0], **now}])

    return messages.select(key, order, "role").groupBy(key).applyInPandasWithState(step, f"{key} long, {STATE}", STATE, "update", "NoTimeout")
