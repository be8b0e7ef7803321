"""Near-duplicates against plain restatements: set joins, random planes, removal in rounds."""

import collections
import math
import random

import numpy as np
import pytest

from corvane.operators import dedup, planes, setjoin


def shingles(text, n=5):
    t = "".join((text or "").split())
    return frozenset({t[k : k + n] for k in range(max(1, len(t) - n + 1))} if t else ())


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts_with_edits(seed, groups=12):
    r, out = random.Random(seed), [None, "", " \n", "abc", "abc", "abcd", "漢字🙂", "漢字 🙂", "abcdef", "abcdeg"]
    for _ in range(groups):
        start = [r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(r.choice([3, 20, 90, 400]))]
        out += [" ".join(w if r.random() > share else f"x{r.randrange(10**4)}" for w in start) for share in (0, 0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15)]
        out.append("\n".join(start[: len(start) * 9 // 10]))
    return out


@pytest.mark.parametrize(("threshold", "seed"), [(0.85, 1), (0.5, 2), (0.94, 3)])
def test_similar_pairs(spark, threshold, seed):
    texts = texts_with_edits(seed)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "abc", "x")], "id long, t string, class_id string")
    pairs, members = setjoin.similar_pairs(rows, "id", ["t"], threshold)
    sets = {i: shingles(t) for i, t in enumerate(texts) if shingles(t)}
    least = {}
    for i, s in sets.items():
        least.setdefault(s, i)
    assert {(m["key"], m["class_id"]) for m in members.collect()} == {(i, least[s]) for i, s in sets.items()}
    heads = sorted(least.values())
    want = {(i, j): jaccard(sets[i], sets[j]) for k, i in enumerate(heads) for j in heads[k + 1 :] if jaccard(sets[i], sets[j]) >= threshold}
    got = {(p["i"], p["j"]): p["similarity"] for p in pairs.collect()}
    assert got == pytest.approx(want) and len(want) > 2
    near = lambda i, j: jaccard(sets[i], sets[j]) >= threshold
    assert {(p["i"], p["j"]) for p in setjoin.expanded(pairs, members).collect()} == {(i, j) for i in sets for j in sets if i < j and near(i, j)}
    links = {x["key"]: (x["class_id"], x["n_links"]) for x in setjoin.linked(pairs, members).collect()}
    assert links == {i: (least[sets[i]], sum(near(i, j) for j in sets if j != i)) for i in sets}


def test_similar_pairs_of_two_texts(spark):
    texts = texts_with_edits(4, 6)
    r = random.Random(5)
    rows = [(i, t, r.choice(texts[-20:] + [t, t])) for i, t in enumerate(texts * 2)]
    pairs, members = setjoin.similar_pairs(spark.createDataFrame(rows, "id long, q string, a string"), "id", ["q", "a"], 0.85)
    real = {i: (shingles(q), shingles(a)) for i, q, a in rows if shingles(q) and shingles(a)}
    want = {(i, j) for i in real for j in real if i < j and all(jaccard(x, y) >= 0.85 for x, y in zip(real[i], real[j]))}
    assert {(p["i"], p["j"]) for p in setjoin.expanded(pairs, members).collect()} == want and len(want) > 20


def test_similar_pairs_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    for some in (rows, rows.limit(0)):
        pairs, members = setjoin.similar_pairs(some, "id", ["t"])
        assert pairs.count() == members.count() == 0


def test_long_sets_speak_of_few_parts():
    """The rows of a set don't grow with it, and of pairs just at the threshold none of 506 is missed, whatever their size."""
    r = np.random.default_rng(3)
    for threshold in (0.85, 0.94):
        dealt = setjoin.Parts(threshold, np.zeros(setjoin.SLOTS))
        for size in (40, 330, 700, 2500, 9000, 60_000):
            g = dealt.class_of(size)
            wanted = dealt.drawn(g)[1]
            assert wanted < 600 and len(dealt.keys(r.integers(0, 1 << 63, size).astype(np.uint64), g)[0]) <= wanted
            for _ in range(50 if size < 10_000 else 3):
                a = r.integers(0, 1 << 63, size).astype(np.uint64)
                n = int(size * (1 - threshold) / (1 + threshold))
                b = np.concatenate([a[n:], r.integers(0, 1 << 63, n).astype(np.uint64)])
                assert len(np.intersect1d(dealt.keys(np.sort(a), g)[0], dealt.keys(np.sort(b), g)[0])) > 0
    old_rows = math.floor(60_000 * 0.15 / 0.85)
    assert len(setjoin.Parts(0.85, np.zeros(setjoin.SLOTS)).keys(np.arange(60_000, dtype=np.uint64) * setjoin._ODD, setjoin.Parts(0.85, np.zeros(1)).class_of(60_000))[0]) < old_rows / 10


def test_sketches_keep_pairs_at_the_threshold():
    """Of pairs just at the threshold none is left out, whatever their size; of pairs with little in common nearly all are."""
    r = np.random.default_rng(4)
    for threshold in (0.5, 0.85, 0.94):
        most = setjoin.allowed(threshold)
        for size in (1, 12, 90, 700, 9000):
            for _ in range(60):
                a = r.integers(0, 1 << 64, size, dtype=np.uint64)
                for shared, near in ((size - int(size * (1 - threshold) / (1 + threshold)), True), (size // 10, False)):
                    b = np.concatenate([a[:shared], r.integers(0, 1 << 64, size - shared, dtype=np.uint64)])
                    apart = int(np.bitwise_count((setjoin.sketch(np.sort(a)) ^ setjoin.sketch(np.sort(b))).view(np.uint64)).sum())
                    assert apart <= most if near else apart > most or size < 700 or threshold == 0.5


def test_large_groups_of_candidates_are_not_gathered(spark, monkeypatch):
    """Candidates aren't dealt by their group, which near copies fill; groups of one chunk and of several give the same pairs."""
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, real = {}, setjoin.stored
    monkeypatch.setattr(setjoin, "stored", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}), real(df, tag))[1])
    try:
        base = [f"w{k}" for k in range(200)]
        texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(40)] + ["another text of its own", "another text of its own!"]
        pairs, _ = setjoin.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"])
        got = {(p["i"], p["j"]) for p in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sets = [shingles(t) for t in texts]
    assert got == {(i, j) for j in range(42) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.85} and len(got) == 781
    assert "SortMergeJoin" not in plans["set-chunks"] and "Exchange hashpartitioning" not in plans["set-chunks"]


def test_near_copies_are_verified_in_chunks_once(spark, monkeypatch):
    """Many near copies of a few texts: texts go to chunks, not to pairs, and counting links doesn't verify pairs twice."""
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    r, texts = random.Random(9), []
    for _ in range(3):
        start = [r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(200)]
        texts += [" ".join(w if r.random() > 0.005 else f"x{r.randrange(10**4)}" for w in start) for _ in range(60)]
    r.shuffle(texts)
    pairs, members = setjoin.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"])
    sets, least = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        least.setdefault(s, i)
    heads = sorted(least.values())
    want = {(i, j): jaccard(sets[i], sets[j]) for k, i in enumerate(heads) for j in heads[k + 1 :] if jaccard(sets[i], sets[j]) >= 0.85}
    assert {(p["i"], p["j"]): p["similarity"] for p in pairs.collect()} == pytest.approx(want) and len(want) > 100
    links = setjoin.linked(pairs, members)
    assert {x["key"]: x["n_links"] for x in links.collect()} == {i: sum(jaccard(s, x) >= 0.85 for x in sets) - 1 for i, s in enumerate(sets)}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow verified" not in plan.replace("FlatMapCoGroupsInArrow", "")


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_near_copies_meet_few_times(spark, monkeypatch, sent):
    """Near copies have dozens of parts in common, but leave the join about twice, and none is lost, whether keys are sent or shuffled."""
    monkeypatch.setattr(setjoin, "SENT", sent)
    met, seen = setjoin._met, []
    monkeypatch.setattr(setjoin, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    r = random.Random(12)
    start = [r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(400)]
    texts = [" ".join(w if r.random() > 0.01 else f"x{r.randrange(10**4)}" for w in start) for _ in range(120)] * 2
    pairs, members = setjoin.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"])
    sets = [shingles(t) for t in texts[:120]]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if jaccard(sets[i], sets[j]) >= 0.85}
    assert {(p["i"], p["j"]) for p in pairs.collect()} == want and len(want) > 1000
    rows, distinct = seen[0].count(), seen[0].distinct().count()
    assert len(want) <= distinct <= 120 * 119 // 2 and rows <= 4 * distinct
    assert {m["class_id"] for m in members.collect()} == set(range(120))


def clustered(seed, n, d, spread):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 12, d))
    return centres[r.integers(0, len(centres), n)] + spread * r.standard_normal((n, d))


@pytest.mark.parametrize(("spread", "bucket", "offset"), [(0.35, 256, 0.0), (0.4, 8, 0.0), (0.35, 256, 2.0)])
def test_near_pairs_recall(spark, spread, bucket, offset):
    """Pairs of 64 dimensions around the threshold, also where all vectors lie in a narrow cone or buckets are cut into blocks."""
    v = clustered(1, 1500, 64, spread) + offset
    v[700] = v[3]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0]]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(5000 + k, x) for k, x in enumerate(bad)] + [(None, [1.0] * 64)]
    threshold = 0.85 if not offset else 0.97
    pairs, members = planes.near_pairs(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", threshold, bucket=bucket)
    classes = {m["key"]: m["class_id"] for m in members.collect()}
    assert classes == {i: 3 if i == 700 else i for i in range(1500)}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.triu(u @ u.T, 1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(sims >= threshold)) if 700 not in (i, j)}
    got = {(p["i"], p["j"]): p["similarity"] for p in pairs.collect()}
    assert set(got) <= want and len(set(got) & want) >= 0.99 * len(want) and len(want) > 500
    assert all(abs(sims[i, j] - s) < 1e-9 for (i, j), s in got.items())


@pytest.mark.parametrize("block", [131_072, 200])
def test_dense_links_and_edges_are_exact(spark, block):
    """All pairs of few dimensions, of which random planes missed some; few and many blocks, copies, and rows in no pair."""
    r = np.random.default_rng(5)
    v = r.standard_normal((3000, 12))
    v[700], v[900] = v[3], v[3]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [None] * 12, [1.0, 2.0]]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(5000 + k, x) for k, x in enumerate(bad)] + [(None, [1.0] * 12)]
    rows = spark.createDataFrame(rows, "id long, e array<double>").selectExpr("id", "slice(e, 1, 6) as a", "slice(e, 7, 6) as q")
    a, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v[:, :6], v[:, 6:]))
    a, q = a @ a.T, q @ q.T
    near = (a >= 0.85).sum(axis=1) - 1
    got = {x["key"]: (x["class_id"], x["n_links"]) for x in dedup.dense_links(rows, "id", "a", 0.85, block).collect()}
    assert got == {i: (3 if i in (700, 900) else i, int(near[i])) for i in range(3000)}
    rule = np.where(a >= dedup.ANSWER, "answer", np.where((a >= dedup.BOTH) & (q >= dedup.QUESTION), "question_answer", ""))
    want = {(int(i), int(j), str(rule[i, j])) for i, j in zip(*np.nonzero(np.triu(rule != "", 1)))}
    found = [tuple(x) for x in dedup.dense_rule_edges(rows, "id", "a", "q", block).collect()]
    assert set(found) == want and len(found) == len(want) > 500
    assert dedup.dense_links(rows.limit(0), "id", "a", 0.85).count() == dedup.dense_rule_edges(rows.limit(0), "id", "a", "q").count() == 0


def test_near_pairs_of_nothing(spark):
    pairs, members = planes.near_pairs(spark.createDataFrame([(1, None)], "id long, e array<float>"), "id", "e", 0.9)
    assert pairs.count() == members.count() == 0 and pairs.columns == ["i", "j", "similarity"]


def test_tables_follow_from_the_chance():
    for threshold, bits in ((0.5, 4), (0.85, 12), (0.93, 16)):
        p = planes.shared_key(threshold, bits)
        assert (1 - p) ** planes.tables_for(threshold, bits) <= planes.MISS < (1 - p) ** (planes.tables_for(threshold, bits) - 1)


def sequential(score, pairs):
    """removed with the rule that removed each first, and the pairs judged."""
    removed, events, by = {}, [], collections.defaultdict(list)
    for i, j, rule in sorted(pairs):
        by[i].append((j, rule))
    for i in sorted(by):
        if i in removed:
            continue
        for j, rule in by[i]:
            if j in removed:
                continue
            events.append((i, j, rule))
            removed.setdefault(i if score[i] < score[j] else j, rule)
    return removed, events


def frames(spark, score, pairs):
    return spark.createDataFrame(list(enumerate(score)), "id long, s double"), spark.createDataFrame(pairs, "i long, j long, rule string")


@pytest.mark.parametrize(("n", "m", "levels"), [(30, 20, 3), (60, 300, 2), (400, 900, 50), (60, 59, 1)])
def test_removals_equal_the_sequential_pass(spark, n, m, levels):
    r = random.Random(n)
    score = [r.randrange(levels) / 2 for _ in range(n)]
    pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})
    pairs = [(*p, r.choice("xy")) for p in pairs]
    removed, events = dedup.removals(*frames(spark, score, pairs), "id", "s")
    want = sequential(score, pairs)
    assert {(x["removed"], x["rule"]) for x in removed.collect()} == set(want[0].items()) and removed.count() == len(want[0])
    assert sorted(tuple(x) for x in events.collect()) == sorted(want[1])


def test_removals_of_a_large_component(spark):
    """One component with a row that all others touch; no task holds the component."""
    r = np.random.default_rng(7)
    n = 20_000
    score = r.integers(0, 100, n) / 10
    pairs = {(0, int(j)) for j in range(1, n)} | {(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, n, (60_000, 2)) if a != b}
    rows, edges = frames(spark, score.tolist(), [(*p, "x") for p in sorted(pairs)])
    score[0] = -1.0
    rows = spark.createDataFrame(list(enumerate(score.tolist())), "id long, s double")
    removed, _ = dedup.removals(rows, edges, "id", "s")
    assert {x["removed"] for x in removed.collect()} == set(sequential(score, [(*p, "x") for p in pairs])[0])


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_removals_write_edges_once(spark, monkeypatch, sent):
    """Edges may be as many as the square of the rows: rounds write rows, and nothing but the first table has edges."""
    monkeypatch.setattr(setjoin, "SENT", sent)
    written, stored = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, tag: written.append(stored(df, tag)) or written[-1])
    r = random.Random(8)
    score = [r.randrange(20) / 2 for _ in range(60)]
    pairs = [(i, j, r.choice("xy")) for i in range(60) for j in range(i + 1, 60) if r.random() < 0.8]
    removed, events = dedup.removals(*frames(spark, score, [*pairs, *pairs[:50], (pairs[3][0], pairs[3][1], "z"), (pairs[5][1], pairs[5][0], "a")]), "id", "s")
    want = sequential(score, pairs)
    assert {(x["removed"], x["rule"]) for x in removed.collect()} == set(want[0].items())
    assert sorted(tuple(x) for x in events.collect()) == sorted(want[1])
    rows = [x.count() for x in written]
    assert rows.count(len(pairs)) == 1 and all(x <= 60 for x in rows if x != len(pairs)) and len(pairs) > 1000


def test_counters_of_rules(spark):
    score = [0.5, 0.9, 0.4, 0.4, 0.7, 0.1]
    rows, surface = frames(spark, score, [(0, 2, "s"), (1, 3, "s")])
    semantic = spark.createDataFrame([(0, 1, "answer"), (1, 4, "question_answer"), (2, 5, "answer"), (4, 5, "answer")], "i long, j long, rule string")
    removed, counters = dedup.removed_by_rules(rows, "id", "s", surface, semantic)
    assert {(x["removed"], x["rule"]) for x in removed.collect()} == {(2, "surface"), (3, "surface"), (0, "answer"), (4, "question_answer")}
    assert {tuple(x) for x in counters.collect()} == {("surface", 2, 2), ("answer", 1, 1), ("question_answer", 1, 1)}
    none = dedup.removed_by_rules(rows, "id", "s", surface.limit(0), semantic.limit(0))
    assert [x.count() for x in none] == [0, 0]
