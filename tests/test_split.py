"""The stratified split against sorting each stratum."""

import math
import random

import pytest

from corvane.operators import split


def plain(rows, share=0.05, least=5):
    """Ids for evaluation of (id, stratum..., score)."""
    strata, out = {}, set()
    for i, *s, v in rows:
        strata.setdefault(tuple(s), []).append((v is not None, math.inf if v is None else v, i))
    order = lambda x: (x[0], x[0] and math.isnan(x[1]), 0 if not x[0] or math.isnan(x[1]) else x[1], x[2])
    for own in strata.values():
        if len(own) >= least:
            out |= {i for *_, i in sorted(own, key=order)[: max(1, round(share * len(own)))]}
    return out


SCHEMA = "id long, a string, b int, score double"


def random_rows(seed, n, kind):
    r = random.Random(seed)
    score = {
        "distinct": lambda: r.random() * 10 ** r.randrange(-8, 9),
        "tied": lambda: float(r.randrange(3)),
        "one": lambda: 2.0,
        "odd": lambda: r.choice([None, math.nan, math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 0.0, -0.0, r.random()]),
    }[kind]
    ids = r.sample(range(-(10**6), 10**6), n)
    return [(i, r.choice(["x", "x", "x", "y", None]), r.choice([1, 1, 1, 1, 2]), score()) for i in ids]


@pytest.mark.parametrize("kind", ["distinct", "tied", "one", "odd"])
@pytest.mark.parametrize(("bins", "small", "broadcast"), [(4096, 4096, 50_000), (4, 3, 0)])
def test_split(spark, monkeypatch, kind, bins, small, broadcast):
    monkeypatch.setattr(split, "BINS", bins)
    monkeypatch.setattr(split, "SMALL", small)
    monkeypatch.setattr(split, "ROUNDS", 30)
    monkeypatch.setattr(split, "BROADCAST_STRATA", broadcast)
    rows = random_rows(len(kind), 700, kind)
    df = spark.createDataFrame(rows, SCHEMA)
    got = split.stratified_split(df, ["a", "b"], "score", "id", 0.13).collect()
    assert got[0].__fields__ == ["id", "a", "b", "score", "split"] and len(got) == len(rows)
    assert {x["id"] for x in got if x["split"] == "eval"} == plain(rows, 0.13)


def test_split_edges(spark):
    df = spark.createDataFrame([(f"k{i}", "s", float(i % 4)) for i in range(100)], "id string, s string, score double")
    got = {x["id"] for x in split.stratified_split(df, ["s"], "score", "id").where("split = 'eval'").collect()}
    assert got == set(sorted((f"k{i}" for i in range(0, 100, 4)))[:5])
    assert split.stratified_split(df.limit(0), ["s"], "score", "id").count() == 0
    few = split.stratified_split(df.limit(4), ["s"], "score", "id")
    assert few.count() == few.where("split = 'train'").count() == 4


def test_no_stratum_is_one_task(spark):
    """A stratum of all rows with distinct scores: no window or shuffle by stratum holds more than a bin's rows."""
    df = spark.range(200_000).selectExpr("id", "'all' as s", "cast(xxhash64(id) as double) as score")
    plan = split.stratified_split(df, ["s"], "score", "id")
    assert plan.where("split = 'eval'").count() == 10_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SortMergeJoin" not in text
