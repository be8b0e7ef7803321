"""Reducers as transition tables: a finite control state and counters that events add to or set.

What a stretch of events does is a table as well (for each control state the next one, and what is added to or set in each
counter), and such tables compose. So a key's events needn't be folded one after the other by one task: they are dealt by
range of key and order, each piece is folded to its table, and the tables of a key, at most one for each partition, are
composed to the state in which each piece begins. The same table drives the streaming form.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .scan import neighbours, scanned

#: A counter's value by which adding is told from setting.
_FAR = 1 << 40


@dataclass(frozen=True)
class Reducer:
    """``fields``: control fields with their values, the first of each at the start; ``counters`` start at 0. ``step`` gives the
    next state (a dict of all fields and counters) for one of ``events``; what it does to counters may depend on the control
    fields only. Other events change nothing."""

    fields: dict[str, tuple]
    counters: tuple[str, ...]
    events: tuple[str, ...]
    step: Callable[[dict[str, Any], str], dict[str, Any]]

    @property
    def controls(self) -> list[tuple]:
        return list(itertools.product(*self.fields.values()))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By control state and event: the next control state, and for each counter whether it is set and the number."""
        controls = self.controls
        at = {c: k for k, c in enumerate(controls)}
        shape = len(controls), len(self.events)
        move, puts, by = np.zeros(shape, dtype=np.int64), np.zeros((*shape, len(self.counters)), dtype=bool), np.zeros((*shape, len(self.counters)), dtype=np.int64)
        for (k, c), (j, e) in itertools.product(enumerate(controls), enumerate(self.events)):
            low, high = (self.step(dict(zip(self.fields, c)) | dict.fromkeys(self.counters, n), e) for n in (0, _FAR))
            move[k, j] = at[tuple(low[f] for f in self.fields)]
            for i, name in enumerate(self.counters):
                puts[k, j, i] = high[name] == low[name]
                by[k, j, i] = low[name]
                if not puts[k, j, i] and high[name] - _FAR != low[name]:
                    raise ValueError(f"{e} neither adds to {name} nor sets it")
        return move, puts, by

    def codes(self, events: list[str | None]) -> list[int]:
        at = {e: k for k, e in enumerate(self.events)}
        return [at.get(e, -1) for e in events]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of one (piece, key) each, and whether the slice begins it; the first two columns are these."""
    last: tuple | None = None
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        begin = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[begin]:
                yield names[begin] != last, batch.slice(begin, k - begin)
                last, begin = names[begin], k


def states_along(rows: DataFrame, key: str, order: str, event: str, reducer: Reducer) -> DataFrame:
    """``rows`` (key, order, event) with the state after each row's event: control fields as text, counters as whole numbers."""
    move, puts, by = reducer.table()
    kind = rows.schema[key].dataType.simpleString()
    placed = stored(rows.select(key, order, event).repartitionByRange(key, order).withColumn("__p__", F.spark_partition_id()), "reducer-rows")
    ordered = lambda df: df.repartition("__p__").sortWithinPartitions("__p__", key, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for new, part in _runs(batches):
            if new:
                held.append((part.column(0)[0].as_py(), part.column(1)[0].as_py(), np.arange(len(move)), np.zeros((len(move), len(reducer.counters)), dtype=bool), np.zeros((len(move), len(reducer.counters)), dtype=np.int64)))
            p, name, now, set_, sums = held.pop()
            for e in reducer.codes(part.column(2).to_pylist()):
                if e >= 0:
                    sums = np.where(puts[now, e], by[now, e], sums + by[now, e])
                    set_, now = set_ | puts[now, e], move[now, e]
            held.append((p, name, now, set_, sums))
            if len(held) > 4096:
                yield packed(held[:-1])
                held = held[-1:]
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        p, name, now, set_, sums = zip(*held)
        flat = [pa.array([x.ravel().tolist() for x in c], pa.list_(t)) for c, t in ((now, pa.int64()), (set_, pa.bool_()), (sums, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(name, part_kind), *flat], ["__p__", key, "now", "puts", "sums"])

    part_kind = rows.select(key).limit(0).toArrow().schema.field(0).type
    pieces = stored(ordered(placed.select("__p__", key, event, order)).mapInArrow(fold, f"__p__ int, `{key}` {kind}, now array<long>, puts array<boolean>, sums array<long>"), "reducer-pieces")
    # The tables before each piece of a key that has several: fewer than the partitions.
    along = Window.partitionBy(key).orderBy("__p__").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(key))).where("many > 1")
    before = before.withColumn("tables", F.collect_list(F.struct("now", "puts", "sums")).over(along)).where(F.size("tables") > 0)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            controls, sums = [], []
            for tables in batch.column(2).to_pylist():
                now, total = 0, np.zeros(len(reducer.counters), dtype=np.int64)
                for t in tables:
                    width = len(reducer.counters)
                    own = slice(now * width, (now + 1) * width)
                    total = np.where(np.array(t["puts"][own], dtype=bool), np.array(t["sums"][own], dtype=np.int64), total + np.array(t["sums"][own], dtype=np.int64))
                    now = t["now"][now]
                controls.append(now)
                sums.append(total.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(controls, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["__q__", "__k__", "control", "sums"])

    starts = before.select("__p__", key, "tables").mapInArrow(begin, f"__q__ int, __k__ {kind}, control long, sums array<long>")
    starts = stored(starts, "reducer-starts")
    joined = placed.join(F.broadcast(starts), (F.col("__p__") == F.col("__q__")) & F.col(key).eqNullSafe(F.col("__k__")), "left")
    controls = reducer.controls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = 0, np.zeros(len(reducer.counters), dtype=np.int64)
        for new, part in _runs(batches):
            if new:
                first, sums = part.column(4)[0].as_py(), part.column(5)[0].as_py()
                now, total = first or 0, np.array(sums or [0] * len(reducer.counters), dtype=np.int64)
            states, counts = [], []
            for e in reducer.codes(part.column(3).to_pylist()):
                if e >= 0:
                    total = np.where(puts[now, e], by[now, e], total + by[now, e])
                    now = move[now, e]
                states.append(now)
                counts.append(total)
            fields = [pa.array([None if controls[s][k] is None else str(controls[s][k]) for s in states], pa.string()) for k in range(len(reducer.fields))]
            numbers = [pa.array([int(c[k]) for c in counts], pa.int64()) for k in range(len(reducer.counters))]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *fields, *numbers], names)

    names = [key, order, *reducer.fields, *reducer.counters]
    schema = f"`{key}` {kind}, `{order}` {rows.schema[order].dataType.simpleString()}, " + ", ".join([f"{f} string" for f in reducer.fields] + [f"{c} long" for c in reducer.counters])
    return ordered(joined.select("__p__", key, order, event, "control", "sums")).mapInArrow(run, schema)


def final_states(rows: DataFrame, key: str, order: str, event: str, reducer: Reducer) -> DataFrame:
    """key and the state after its last event. A key's orders are distinct."""
    along = states_along(rows, key, order, event, reducer)
    last = along.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in along.columns[2:]]), order).alias("s"))
    return last.select(key, "s.*")


# --- the dialogue and the panel beside it ---
def _dialogue(s: dict[str, Any], kind: str) -> dict[str, Any]:
    if kind == "reset":
        return {"status": "idle", "open": False, "error": None, "user_turns": 0, "messages": 0}
    if kind == "booting":
        return s | {"status": "booting", "error": None}
    if kind == "user":
        return s | {"user_turns": s["user_turns"] + 1, "messages": s["messages"] + 1, "error": None}
    if kind == "start":
        return s | {"status": "streaming", "messages": s["messages"] + 1, "open": True}
    if kind == "done":
        return s | {"status": "idle", "open": False}
    # An error drops the answer that is being written.
    return s | {"status": "idle", "messages": s["messages"] - int(s["open"]), "open": False, "error": "error"}


DIALOGUE = Reducer({"status": ("idle", "booting", "streaming"), "open": (False, True), "error": (None, "error")}, ("user_turns", "messages"), ("reset", "booting", "user", "start", "done", "error"), _dialogue)


def gate(states: DataFrame) -> DataFrame:
    """``states`` with ``may_leave``: the dialogue is idle and the user has spoken."""
    return states.withColumn("may_leave", (F.col("status") == "idle") & (F.col("user_turns") >= 1))


def panel_states(rows: DataFrame, key: str, order: str, event: str, screen: str) -> DataFrame:
    """The state after each event of a dialogue that starts anew when the screen changes (a null screen is the one before).
    ``order`` is a whole number."""
    known = scanned(rows.select(key, order, event, screen), [key], order, carried={"__now__": screen}, counted={"__n__": order})
    known = stored(neighbours(known, [key], "__n__", "__now__").drop("following"), "panel-rows")
    changed = known.where("__now__ is not null and __n__ > 1 and not (previous <=> __now__)")
    events = known.select(key, (F.col("__n__") * 2 + 1).alias("__at__"), F.col(event).alias("__e__"))
    resets = changed.select(key, (F.col("__n__") * 2).alias("__at__"), F.lit("reset").alias("__e__"))
    states = states_along(events.unionByName(resets), key, "__at__", "__e__", DIALOGUE).where("__at__ % 2 = 1").withColumnRenamed(key, "__k__")
    same = [F.col(key).eqNullSafe(F.col("__k__")), F.col("__n__") * 2 + 1 == F.col("__at__")]
    return known.join(states, same).select(key, order, F.col("__now__").alias("screen"), *DIALOGUE.fields, *DIALOGUE.counters)


def stream_states(messages: DataFrame, key: str, order: str, event: str, reducer: Reducer) -> DataFrame:
    """The streaming form: a key's state is kept between batches and given out whenever the key has events. Batches arrive in
    order."""
    move, puts, by = reducer.table()
    controls, width = reducer.controls, len(reducer.counters)
    kind = messages.schema[key].dataType.simpleString()
    names = [*reducer.fields, *reducer.counters]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, total = (state.get[0], np.array(state.get[1], dtype=np.int64)) if state.exists else (0, np.zeros(width, dtype=np.int64))
        for e in reducer.codes(pd.concat(list(batches)).sort_values(order)[event].tolist()):
            if e >= 0:
                total = np.where(puts[now, e], by[now, e], total + by[now, e])
                now = int(move[now, e])
        state.update((now, total.tolist()))
        fields = [None if x is None else str(x) for x in controls[now]]
        yield pd.DataFrame([[k[0], *fields, *total.tolist()]], columns=[key, *names])

    schema = f"`{key}` {kind}, " + ", ".join([f"{f} string" for f in reducer.fields] + [f"{c} long" for c in reducer.counters])
    return messages.select(key, order, event).groupBy(key).applyInPandasWithState(step, schema, "control long, sums array<long>", "update", "NoTimeout")
