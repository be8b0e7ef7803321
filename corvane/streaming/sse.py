"""Answers from streams of bytes: unfinished lines and open answers are state, silent streams are closed by a timer.

Bytes arrive cut anywhere, also inside a line or a character, and in any number of batches. The state of a stream is the rest
after its last line feed, the deltas so far (a list, so that a long answer isn't written anew for each batch), and what
is known of its end. ``answers`` of ``operators.sessions`` over whole lines is the batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sessions as P

ANSWER = "content string, usage int, finish_reason string, failed boolean, done boolean, breach string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(line: bytes) -> dict[str, Any] | None:
    """The event of a ``data:`` line; None for other lines, end markers, broken JSON and events without a type."""
    text = line.decode("utf-8", "replace")
    if not text.startswith("data: "):
        return None
    body = text[6:].strip()
    if body == "[DONE]":
        return None
    try:
        event = json.loads(body)
    except ValueError:
        return None
    return event if isinstance(event, dict) and isinstance(event.get("type"), str) else None


class Answers(StatefulProcessor):
    """A row for each stream when it ends, or when nothing has come for ``silence`` milliseconds of event time."""

    def __init__(self, key: str, silence: int):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Every use of state or timers is a call to the JVM, so there is one value for all but the deltas, and the timer's time is in it.
        self.handle = handle
        self.stream = handle.getValueState("stream", "rest binary, events long, usage int, finish_reason string, breach string, closed boolean, held boolean, timer long")
        self.deltas = handle.getListState("deltas", "delta string")

    def _answer(self, key: tuple, deltas: list[str], held: bool, usage: int | None, reason: str | None, failed: bool, done: bool, breach: str | None) -> Row:
        before = [x[0] for x in self.deltas.get()] if held and not failed else []
        if held:
            self.deltas.clear()
        content = None if failed else "".join(before + deltas)
        return Row(**{self.key: key[0]}, content=content, usage=usage, finish_reason=reason, failed=failed, done=done, breach=breach)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        buffer, events, usage, reason, breach, closed, held, timer = self.stream.get() or (b"", 0, None, None, None, False, False, None)
        parts = sorted(rows, key=lambda x: x["seq"])
        *lines, buffer = (bytes(buffer) + b"".join(bytes(x["bytes"]) for x in parts if x["bytes"] is not None)).split(b"\n")
        deltas: list[str] = []
        for line in lines:
            event = frame(line)
            if event is None or closed:  # what follows an end changes nothing
                continue
            kind, events = event["type"], events + 1
            if events == 1 and kind != "metadata":
                breach = breach or "no_metadata"
            elif events > 1 and kind == "metadata":
                breach = breach or "second_metadata"
            usage = event["usage"] if isinstance(event.get("usage"), int) else usage
            reason = event["finish_reason"] if isinstance(event.get("finish_reason"), str) else reason
            if kind == "delta":
                deltas.append(str(event.get("content") or ""))
            elif kind in ("done", "error"):
                closed = True
                yield self._answer(key, deltas, held, usage, reason, kind == "error", kind == "done", breach)
                deltas, held = [], False
        if deltas:
            self.deltas.appendList([(x,) for x in deltas])
            held = True
        end = max(x["ms"] for x in parts) + self.silence
        if end != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
        self.stream.update((buffer, events, usage, reason, breach, closed, held, end))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The stream is silent: its answer so far, if it never ended; its state goes."""
        _, events, usage, reason, breach, closed, held, _ = self.stream.get()
        if events and not closed:
            yield self._answer(key, [], held, usage, reason, False, False, breach or "no_end")
        self.stream.clear()

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with lists and timers needs the RocksDB store while a query runs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def answer_stream(chunks: DataFrame, key: str, late: str = "1 minute", silence: int = 600_000) -> DataFrame:
    """Streaming answers from chunks (key, seq, bytes, at), whose batches arrive in the order of ``seq`` for each stream."""
    rows = chunks.select(key, "seq", "bytes", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late).groupBy(key)
    kind = chunks.schema[key].dataType.simpleString()
    return rows.transformWithState(Answers(key, silence), f"{key} {kind}, {ANSWER}", "Append", "EventTime")


def answers_of_bytes(chunks: DataFrame, key: str) -> DataFrame:
    """The batch twin: a stream's bytes are put together, cut into whole lines and folded."""
    held = F.array_sort(F.collect_list(F.struct("seq", "bytes")))
    whole = F.aggregate(held, F.lit("").cast("binary"), lambda a, x: F.concat(a, F.coalesce(x["bytes"], F.lit("").cast("binary"))))
    lines = chunks.groupBy(key).agg(F.split(whole.cast("string"), "\n").alias("lines"))
    numbered = lines.select(key, F.posexplode(F.slice("lines", F.lit(1), F.size("lines") - 1)).alias("seq", "line"))
    events = P.frames(numbered, key, "seq", "line")
    # Events after the first end change nothing.
    end = events.where(F.col("type").isin("done", "error")).groupBy(key).agg(F.min("seq").alias("__end__"))
    kept = events.join(end, key, "left").where("__end__ is null or seq <= __end__").drop("__end__")
    first = P.contract_breaches(kept, key, "seq").groupBy(key).agg(F.min_by("breach", "seq").alias("breach"))
    return P.answers(kept, key, "seq").join(first, key, "left")
