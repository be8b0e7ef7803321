"""Nearest rows against comparing everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import nearest, retrieve


@pytest.mark.parametrize(("n", "part", "metric"), [(900, 8192, "l2"), (900, 40, "l2"), (400, 50, "cosine"), (3, 8192, "l2")])
def test_nearest_vectors(spark, monkeypatch, n, part, metric):
    monkeypatch.setattr(nearest, "ROW_PART", part)
    monkeypatch.setattr(nearest, "QUERY_PART", part)
    monkeypatch.setattr(nearest, "CELL_ROWS", 30)
    r = np.random.default_rng(n)
    v = r.standard_normal((max(1, n // 30), 5))[r.integers(0, max(1, n // 30), n)] + 0.1 * r.standard_normal((n, 5))
    v[: n // 3] = v[0]  # a hot vector: ties by id
    rows = spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)] + [(n + 1, None, 0)], "id long, embedding array<double>, label int")
    got = retrieve.knn(rows, rows.where("id % 7 = 0"), 6, metric=metric, where=F.col("label") != 1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {(x["query"], x["rank"]): (x["id"], x["distance"]) for x in got.collect()}
    for q in range(0, n, 7):
        d = 1 - u @ u[q] if metric == "cosine" else np.linalg.norm(v - v[q], axis=1)
        order = sorted((float(d[i]), i) for i in range(n) if i % 3 != 1)[:6]
        assert len([1 for a, _ in found if a == q]) == len(order)
        assert np.allclose([found[q, k + 1][1] for k in range(len(order))], [x for x, _ in order], atol=1e-6)
        exact = [i for x, i in order if x > 1e-5]
        assert [found[q, k + 1][0] for k in range(len(order)) if order[k][0] > 1e-5] == exact or q < n // 3


def test_nearest_vectors_skip_cells(spark, monkeypatch):
    """Where rows lie in groups, few of the cells are searched."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    r = np.random.default_rng(2)
    v = 50 * r.standard_normal((30, 8))[r.integers(0, 30, 3000)] + r.standard_normal((3000, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    seen = []
    searched = nearest._searched

    def counted(rows, asked, cells, k):
        seen.append(asked.join(cells, "cell").agg(F.sum("n")).first()[0] or 0)
        return searched(rows, asked, cells, k)

    nearest._searched = counted
    try:
        got = nearest.nearest_vectors(rows, rows.where("id < 60").select(F.col("id").alias("query"), F.col("v").alias("q")), 5)
        best = {(x["query"], x["rank"]): x["id"] for x in got.collect()}
    finally:
        nearest._searched = searched
    for q in range(60):
        d = np.linalg.norm(v - v[q], axis=1)
        assert [best[q, k + 1] for k in range(5)] == [i for _, i in sorted((x, i) for i, x in enumerate(d))[:5]]
    assert sum(seen) < 0.2 * 60 * 3000
    assert nearest.nearest_vectors(rows.limit(0), rows.select(F.col("id").alias("query"), F.col("v").alias("q")), 5).count() == 0


def test_sparse_top(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 8)
    r = random.Random(1)
    frequent, rare = ["the", "of"], [f"t{k}" for k in range(200)]
    docs = {i: {t: float(r.randrange(1, 1 + (40 if i % 97 == 0 else 4))) for t in frequent + r.sample(rare, r.randrange(1, 12))} for i in range(2000)}
    asks = {q: {t: float(r.randrange(-1 if q == 5 else 1, 4)) for t in frequent + r.sample(rare, 4)} for q in range(12)} | {50: {"nowhere": 1.0}, 51: {"t1": 1.0}}
    corpus = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()] + [(1, None, 9.0)], "id long, term string, weight double")
    queries = spark.createDataFrame([(q, t, w) for q, d in asks.items() for t, w in d.items()], "query long, term string, weight double")
    scored = []
    plain = nearest.sparse_scored

    def counted(chosen, queries, postings):
        scored.append(chosen.join(queries, "query").select("query", "block", "term").join(postings, ["block", "term"]).count())
        return plain(chosen, queries, postings)

    monkeypatch.setattr(nearest, "sparse_scored", counted)
    got = {(x["query"], x["rank"]): (x["id"], x["score"]) for x in nearest.sparse_top(corpus, queries, 7).collect()}
    pairs = 0
    for q, ask in asks.items():
        scores = {i: sum(w * d[t] for t, w in ask.items() if t in d) for i, d in docs.items() if set(d) & set(ask)}
        pairs += sum(len(set(d) & set(ask)) for d in docs.values())
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [got[q, k + 1] for k in range(len(want))] == want and (q, len(want) + 1) not in got
    assert sum(scored) < pairs / 5
    assert nearest.sparse_top(corpus.limit(0), queries, 7).count() == nearest.sparse_top(corpus, queries.limit(0), 7).count() == 0


@pytest.mark.parametrize(("n", "values"), [(500, 60), (500, 3), (40, 100_000), (2, 5)])
def test_nearest_values(spark, n, values):
    r = random.Random(n)
    corpus = [(i, r.randrange(values) if i % 3 else values // 2) for i in range(n)]
    queries = [(q, r.randrange(-values // 2, 2 * values)) for q in range(60)]
    got = nearest.nearest_values(
        spark.createDataFrame([*corpus, (n + 7, None)], "id long, value long"), spark.createDataFrame([*queries, (900, None)], "query long, value long"), 4
    ).collect()
    found = {(x["query"], x["rank"]): (x["distance"], x["id"]) for x in got}
    for q, v in queries:
        want = sorted((abs(x - v), i) for i, x in corpus)[:4]
        assert [found[q, k + 1] for k in range(len(want))] == want
    assert len(found) == len(got) == 60 * min(4, n)
    nothing = spark.createDataFrame([], "id long, value long")
    assert nearest.nearest_values(nothing, spark.createDataFrame(queries, "query long, value long"), 4).count() == 0


@pytest.mark.parametrize(("weights", "pool"), [(1 << 22, 1 << 16), (1 << 22, 7), (0, 7)])
def test_text_top(spark, monkeypatch, weights, pool):
    """Texts are scored where they stand, or by rows for each term if the queries are too many; ties, repeated ids, nulls and empty texts."""
    monkeypatch.setattr(nearest, "WEIGHTS", weights)
    monkeypatch.setattr(nearest, "POOL", pool)
    r = random.Random(8)
    words = [f"w{x}" for x in range(25)] + [""]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(300)]
    texts += [(7, "w1 w1"), (7, None), (None, "w1 w2"), (900, None), (901, "none of them")]
    asked = [(q, f"w{x}" if x < 25 else "", r.randrange(1, 4)) for q in range(9) for x in r.sample(range(26), 5)] + [(40, "unseen", 1), (41, None, 2)]
    held = {}
    for i, t in texts:
        if i is not None and t is not None:
            held.setdefault(i, []).extend(t.split(" "))
    want = set()
    for q in {x[0] for x in asked}:
        scores = [(-sum(w * terms.count(t) for a, t, w in asked if a == q and t is not None), i) for i, terms in held.items()]
        want |= {(q, i, -s, rank + 1) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0])[:6])}
    rows = spark.createDataFrame(texts, "id long, text string")
    found = nearest.text_top(rows, spark.createDataFrame(asked, "query long, term string, weight long"), 6)
    assert {(x["query"], x["id"], x["score"], x["rank"]) for x in found.collect()} == want and found.count() == len(want) == 54
    assert nearest.text_top(rows, spark.createDataFrame([], "query long, term string, weight long"), 6).count() == 0
    assert dict(found.dtypes)["score"] == "bigint"
