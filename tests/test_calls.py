"""Calls in flight, deadlines, retries, fallback records and dead letters."""

import asyncio

from corvane.operators import calls


def make_call():
    """A service that knows how many calls it serves at once in this process; made anew inside each task."""
    seen = {"now": 0, "tries": {}}

    async def call(prompt):
        seen["now"] += 1
        now = seen["now"]
        try:
            n = seen["tries"][prompt] = seen["tries"].get(prompt, 0) + 1
            if prompt == "hang":
                await asyncio.sleep(60)
            await asyncio.sleep(0.02)
            if prompt == "broken" or (prompt == "second" and n < 2):
                raise ValueError("down")
            return f"{now}"
        finally:
            seen["now"] -= 1

    return call


def test_calls(spark, tmp_path):
    prompts = ["hang", "broken", "second", None] + [f"p{k}" for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")
    policy = calls.Policy(slots=6, tries=2, deadline=0.5, wait=0.01, fallback="sorry")
    done = calls.called(rows, "id", "prompt", make_call(), policy, tasks=2)
    assert done.rdd.getNumPartitions() == 2
    got = {x["id"]: x for x in done.collect()}
    assert len(got) == len(prompts)
    assert tuple(got[0])[1:] == ("sorry", "timeout", 2) and tuple(got[1])[1:] == ("sorry", "ValueError: down", 2)
    assert got[2]["tries"] == 2 and got[2]["error"] is None and got[3]["error"] is None
    flight = [int(x["answer"]) for x in got.values() if x["error"] is None]
    assert max(flight) <= 3 and max(flight) > 1  # three of six slots in each of two tasks
    calls.dead_letters(done, f"{tmp_path}/dead")
    assert {(x["id"], x["error"]) for x in spark.read.parquet(f"{tmp_path}/dead").collect()} == {(0, "timeout"), (1, "ValueError: down")}
    assert calls.called(rows.limit(0), "id", "prompt", make_call(), policy).count() == 0


def test_pauses():
    assert [calls.Policy().pause(k) for k in (1, 2, 3)] == [0.5, 1.0, 1.5]
    assert [calls.Policy(doubling=True, wait=1.0).pause(k) for k in (1, 2, 3)] == [1.0, 2.0, 4.0]
