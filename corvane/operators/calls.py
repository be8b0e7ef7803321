"""Calls of slow services, one for each row: a bounded number in flight, deadlines, retries, fallback records, dead letters."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str | None], Awaitable[str]]
RESULT = "answer string, error string, tries int"


@dataclass(frozen=True)
class Policy:
    """``slots``: calls in flight, over all tasks. ``deadline``: seconds of one try. After try k a row waits ``wait * k`` seconds,
    or ``wait * 2 ** (k - 1)`` if ``doubling``. ``fallback``: the answer of a row whose tries all failed."""

    slots: int = 16
    tries: int = 3
    deadline: float = 30.0
    wait: float = 0.5
    doubling: bool = False
    fallback: str | None = None

    def pause(self, k: int) -> float:
        return self.wait * 2 ** (k - 1) if self.doubling else self.wait * k


async def _one(call: Call, prompt: str | None, policy: Policy, slots: asyncio.Semaphore) -> tuple[str | None, str | None, int]:
    error = ""
    for k in range(1, policy.tries + 1):
        # A row that waits for its next try holds no slot.
        async with slots:
            try:
                return await asyncio.wait_for(call(prompt), policy.deadline), None, k
            except TimeoutError:
                error = "timeout"
            except Exception as e:  # a call's failure must not fail the job
                error = f"{type(e).__name__}: {e}"[:300]
        if k < policy.tries:
            await asyncio.sleep(policy.pause(k))
    return policy.fallback, error, policy.tries


async def _all(call: Call, prompts: list[str | None], policy: Policy, slots: int) -> list[tuple[str | None, str | None, int]]:
    own = asyncio.Semaphore(slots)
    return await asyncio.gather(*(_one(call, p, policy, own) for p in prompts))


def called(rows: DataFrame, key: str, prompt: str, call: Call, policy: Policy = Policy(), tasks: int | None = None) -> DataFrame:
    """key, answer, error, tries for each row. ``error`` is null for a good answer; a row whose tries all failed has the fallback
    as its answer. Rows are dealt over ``tasks`` tasks (as many as run at once, unless given), which share the slots, so
    no more than ``policy.slots`` calls are in flight however many rows or executors there are. Null prompts are called as None;
    a task that runs again calls again.
    """
    tasks = max(1, min(policy.slots, tasks or rows.sparkSession.sparkContext.defaultParallelism))
    share = policy.slots // tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                done = asyncio.run(_all(call, batch.column(1).to_pylist(), policy, share))
                answers, errors, tries = (list(x) for x in zip(*done))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())], [key, "answer", "error", "tries"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, prompt).repartition(tasks).mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def dead_letters(results: DataFrame, path: str) -> DataFrame:
    """Failed rows are appended to the table at ``path`` with the time; returned are all rows as they are. ``results`` should be a
    stored table, since it is read twice."""
    results.where("error is not null").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    return results
