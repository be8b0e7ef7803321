"""Prefix scans against running along each key."""

import random

import pytest

from corvane.operators import scan


def plain(rows):
    state, out = {}, {}
    for book, line, num in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        last, n, falls = state.get(book, (None, 0, 0))
        if num is not None:
            n, falls, last = n + 1, falls + (num <= (last or 0)), num
        state[book] = last, n, falls
        out[book, line] = state[book]
    return out


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("books", [[1], [1, 2, None, 3], list(range(40))])
def test_scan(spark, books):
    r = random.Random(len(books))
    rows = [(b, k, r.choice([None, None, -1, 0, r.randrange(9)])) for b in books for k in range(3 if len(books) > 10 else 700)]
    df = spark.createDataFrame(rows, "book long, line_no int, num int").repartition(5)
    got = scan.scanned(df, ["book"], "line_no", carried={"c": "num"}, counted={"n": "num"}, resets={"r": "num"})
    assert got.columns == ["book", "line_no", "num", "c", "n", "r"]
    assert {(x["book"], x["line_no"]): (x["c"], x["n"], x["r"]) for x in got.collect()} == plain(rows) and got.count() == len(rows)
    if books == [1]:
        assert scan.scanned(df, ["book"], "line_no", counted={"n": "num"}).rdd.glom().filter(len).count() > 1
    assert scan.scanned(df.limit(0), ["book"], "line_no", carried={"c": "num"}, resets={"r": "num"}).count() == 0


def test_neighbours(spark):
    rows = [(b, k, f"{b}-{k}") for b in (1, None) for k in range(6)]
    got = scan.neighbours(spark.createDataFrame(rows, "b int, o int, v string"), ["b"], "o", "v").collect()
    for x in got:
        assert x["previous"] == (f"{x['b']}-{x['o'] - 1}" if x["o"] else None) and x["following"] == (f"{x['b']}-{x['o'] + 1}" if x["o"] < 5 else None)
    assert len(got) == 12


def test_neighbours_across_spans(spark):
    """The places beside a span's ends, gaps and null places; and the joins that Spark would send whole are gone."""
    places = [-1, 0, 1, 4094, 4095, 4096, 4097, 8191, 8193, 12288, 2**31 - 1, None]
    rows = [(b, k, f"{b}-{k}") for b in (1, 2, None) for k in places]
    got = scan.neighbours(spark.createDataFrame(rows, "b int, o int, v string"), ["b"], "o", "v")
    beside = lambda b, k: f"{b}-{k}" if k in places else None
    want = [(b, k, v, *((beside(b, k - 1), beside(b, k + 1)) if k is not None else (None, None))) for b, k, v in rows]
    assert got.columns == ["b", "o", "v", "previous", "following"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
