"""Streams of bytes, cut anywhere, against the batch twin over whole bytes."""

import datetime
import json
import random

import pytest

from corvane.streaming import sse

SCHEMA = "id long, seq long, bytes binary, at timestamp"


def stream_of(r, k):
    events = [{"type": "metadata"}] if k % 9 != 5 else []
    events += [{"type": "delta", "content": r.choice(["é🙂", "word ", "漢", "\n", '"', ""])} for _ in range(r.randrange(12))]
    if k % 9 == 6:
        events.insert(2, {"type": "metadata"})
    lines = [f"data: {json.dumps(e, ensure_ascii=bool(k % 2))}" for e in events]
    lines[1:1] = [": note", "data: {broken", "data: [1]", "", "event: x"][: r.randrange(6)]
    if k % 9 == 3:
        lines.append('data: {"type":"error","message":"x"}')
    elif k % 9 != 4:
        lines.append('data: {"type":"done","usage":7,"finish_reason":"stop"}')
    if k % 9 == 8:
        lines.append('data: {"type":"delta","content":"late"}')
    lines += ["data: [DONE]", 'data: {"type":"del'] if k % 2 else ["data: [DONE]"]
    return ("\n".join(lines) + ("" if k % 2 else "\n")).encode()


@pytest.mark.parametrize("size", [1, 7])
def test_any_cut_gives_the_same_answers(spark, tmp_path, size):
    r = random.Random(size)
    start = datetime.datetime(2024, 1, 1)
    rows = [[], [], []]
    for k in range(20):
        data, at, seq = stream_of(r, k), 0, 0
        cuts = sorted(r.sample(range(len(data)), 2))
        while at < len(data):
            n = r.randrange(1, 2 + 6 * size)
            batch = sum(at >= c for c in cuts)
            rows[batch].append((k, seq, data[at : at + n], start + datetime.timedelta(minutes=batch)))
            at, seq = at + n, seq + 1
    rows[2].append((-1, 0, b"", start + datetime.timedelta(days=1)))  # time goes on
    twin = {x["id"]: tuple(x) for x in sse.answers_of_bytes(spark.createDataFrame(sum(rows, []), SCHEMA), "id").select("id", "content", "usage", "finish_reason", "failed", "done", "breach").collect()}
    got = []
    with sse.rocks(spark):
        for batch in rows:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = sse.answer_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "id")
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len({x[0] for x in got}) and {x[0]: x for x in got} == twin
    assert {x[6] for x in got} == {None, "no_end", "no_metadata", "second_metadata"} and sum(x[4] for x in got) >= 2


class Calls:
    """State and timers of one key in memory; every use counts."""

    def __init__(self):
        self.made, self.value, self.items, self.timers = 0, None, [], set()

    def getValueState(self, name, schema):
        calls = self

        class Value:
            def get(self):
                calls.made += 1
                return calls.value

            def update(self, value):
                calls.made, calls.value = calls.made + 1, value

            def clear(self):
                calls.made, calls.value = calls.made + 1, None

        return Value()

    def getListState(self, name, schema):
        calls = self

        class Items:
            def get(self):
                calls.made += 1
                return iter(calls.items)

            def appendList(self, items):
                calls.made, calls.items = calls.made + 1, calls.items + items

            def clear(self):
                calls.made, calls.items = calls.made + 1, []

        return Items()

    def registerTimer(self, at):
        self.made += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.made += 1
        self.timers.remove(at)


def test_a_batch_uses_state_a_few_times():
    """Each use of state is a call to the JVM, which took most of the time."""
    calls = Calls()
    answers = sse.Answers("id", 100)
    answers.init(calls)
    data = b'data: {"type":"metadata"}\ndata: {"type":"delta","content":"a"}\ndata: {"type":"delta","content":"b"}\ndata: {"type":"done","usage":7,"finish_reason":"stop"}\n'
    row = lambda seq, a, b, ms: {"id": 5, "seq": seq, "bytes": data[a:b], "ms": ms}
    assert not list(answers.handleInputRows((5,), iter([row(1, 30, 70, 7), row(0, 0, 30, 6)]), None))
    assert calls.made <= 4 and calls.timers == {107}
    calls.made = 0
    (got,) = answers.handleInputRows((5,), iter([row(2, 70, len(data), 8)]), None)
    assert tuple(got) == (5, "ab", 7, "stop", False, True, None) and calls.made <= 6 and calls.timers == {108}
    assert not list(answers.handleInputRows((5,), iter([row(3, 0, len(data), 8)]), None)) and calls.timers == {108}
    assert not list(answers.handleExpiredTimer((5,), None, None)) and calls.value is None and not calls.items
    list(answers.handleInputRows((5,), iter([row(0, 0, 70, 6)]), None))
    (got,) = answers.handleExpiredTimer((5,), None, None)
    assert tuple(got) == (5, "a", None, None, False, False, "no_end") and calls.value is None and not calls.items
