"""Keyed tables: versions, deletes that tell, migrations, crashes."""

import pytest
from pyspark.sql import functions as F

from corvane.sources.keyed import KeyedTable


def rows_of(table):
    return sorted(tuple(r) for r in table.rows().collect())


def test_keyed_table(spark, tmp_path, monkeypatch):
    slots = KeyedTable(spark, f"file://{tmp_path}/slots", "k", "k long, v string", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert rows_of(slots) == []
    slots.upsert(frame([(k, f"a{k}") for k in range(10)]))
    before = slots._state()[1]["buckets"]
    slots.upsert(frame([(3, "b3"), (99, None)]))
    assert rows_of(slots) == sorted([(k, f"a{k}") for k in range(10) if k != 3] + [(3, "b3"), (99, None)])
    after = slots._state()[1]["buckets"]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2  # only the keys' buckets are copied
    assert [r["v"] for r in slots.get(3).collect()] == ["b3"] and slots.get(12345).count() == 0
    version = slots._state()[0]
    assert {tuple(r) for r in slots.delete(spark.createDataFrame([(3,), (77,), (3,)], "k long")).collect()} == {(3, True), (77, False)}
    assert {tuple(r) for r in slots.delete(spark.createDataFrame([(3,)], "k long")).collect()} == {(3, False)} and slots._state()[0] == version + 1
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="null or repeats"):
            slots.upsert(frame(bad))

    # A crash between the write and its manifest, and two writers of one version.
    held = rows_of(slots)
    commit = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        slots.upsert(frame([(5, "lost")]))
    monkeypatch.setattr(KeyedTable, "_commit", commit)
    assert rows_of(slots) == held == rows_of(KeyedTable(spark, f"file://{tmp_path}/slots", "k", "k long"))
    with pytest.raises(RuntimeError, match="by another"):
        slots._commit(slots._state()[0], {})

    steps = [("v2", lambda df: df.withColumn("n", F.length("v"))), ("v3", lambda df: df.withColumnRenamed("v", "text"))]
    assert slots.migrate(steps[:1]) == ["v2"] and slots.migrate(steps) == ["v3"] and slots.migrate(steps) == []
    assert slots.rows().columns == ["k", "text", "n"] and [r["n"] for r in slots.get(99).collect()] == [None]
    with pytest.raises(ValueError, match="the ledger has v2"):
        slots.migrate(steps[::-1])
    slots.vacuum()
    assert slots.rows().count() == len(held)
