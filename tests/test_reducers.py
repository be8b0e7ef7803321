"""Reducers in pieces and as streams against folding the events one by one."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import reducers
from corvane.streaming import twins

LIGHTS = reducers.Reducer(
    {"light": ("red", "green")}, ("rounds", "waits"), ("go", "stop", "clear"),
    lambda s, e: {"go": s | {"light": "green", "rounds": s["rounds"] + (s["light"] == "red")}, "stop": s | {"light": "red", "waits": s["waits"] + 2}, "clear": s | {"rounds": 0}}[e],
)


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(reducer, events):
    state = {f: v[0] for f, v in reducer.fields.items()} | dict.fromkeys(reducer.counters, 0)
    out = []
    for e in events:
        state = reducer.step(state, e) if e in reducer.events else state
        out.append(tuple(None if state[f] is None else str(state[f]) for f in reducer.fields) + tuple(state[c] for c in reducer.counters))
    return out


@pytest.mark.parametrize("reducer", [reducers.DIALOGUE, LIGHTS])
def test_states(spark, tmp_path, reducer):
    """One key holds nearly all events, so it lies in several partitions."""
    r = random.Random(len(reducer.events))
    keys = [None, 1, 2] + [7] * 900
    rows = [(k, n, r.choice([*reducer.events, "other", None])) for n, k in enumerate(keys * 2)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, o int, e string")
    own = {k: sorted((o, e) for x, o, e in rows if x == k) for k in {None, 1, 2, 7}}
    want = {(k, o): s for k, x in own.items() for (o, _), s in zip(x, plain(reducer, [e for _, e in x]))}
    got = reducers.states_along(df, "k", "o", "e", reducer)
    assert {(x[0], x[1]): tuple(x)[2:] for x in got.collect()} == want
    finals = {k: want[k, x[-1][0]] for k, x in own.items()}
    assert {x[0]: tuple(x)[1:] for x in reducers.final_states(df, "k", "o", "e", reducer).collect()} == finals
    assert reducers.states_along(df.limit(0), "k", "o", "e", reducer).count() == 0
    # As a stream, in two batches.
    seen = {}
    for part in ("o < 700", "o >= 700"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = reducers.stream_states(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "o", "e", reducer)
        sink = lambda batch, _: seen.update({x[0]: tuple(x)[1:] for x in batch.collect()})
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    assert seen == finals


def test_dialogue_table_is_the_reducer():
    r = random.Random(3)
    for _ in range(200):
        state, events = dict(twins.START), [r.choice(reducers.DIALOGUE.events) for _ in range(12)]
        for e, s in zip(events, plain(reducers.DIALOGUE, events)):
            state = twins.dialogue(state, e)
            assert s == (state["status"], str(state["open"]), state["error"], state["user_turns"], state["messages"])
    with pytest.raises(ValueError, match="neither adds"):
        reducers.Reducer({"a": (0,)}, ("n",), ("double",), lambda s, _: s | {"n": s["n"] * 2 + 1}).table()


def test_panel_starts_anew_with_a_screen(spark):
    r = random.Random(6)
    rows = [(k, 3 * o, r.choice(reducers.DIALOGUE.events), r.choice([None, "a", "a", "b"])) for k in (1, 2) for o in range(150)]
    got = {(x["k"], x["o"]): tuple(x)[2:] for x in reducers.panel_states(spark.createDataFrame(rows, "k long, o long, e string, s string"), "k", "o", "e", "s").collect()}
    for k in (1, 2):
        state = dict(twins.START)
        for _, o, e, s in sorted(x for x in rows if x[0] == k):
            state = twins.panel(state, e, s)
            assert got[k, o] == (state["screen"], state["status"], str(state["open"]), state["error"], state["user_turns"], state["messages"])
    assert len(got) == 300


def test_gate(spark):
    rows = [(1, n, e) for n, e in enumerate(["start", "done", "user", "start", "done"])]
    along = reducers.states_along(spark.createDataFrame(rows, "k long, o long, e string"), "k", "o", "e", reducers.DIALOGUE)
    assert [x["may_leave"] for x in reducers.gate(along).orderBy(F.col("o")).collect()] == [False, False, True, False, True]
