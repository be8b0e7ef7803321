"""Semantics that are easy to lose: order, rounding, white space, nulls, greedy removal, state machines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import render, scores
from corvane.functions import text as T
from corvane.operators import curate, dedup, evaluate, plugins, retrieve, segment, sessions, split
from corvane.sources import jsonl, tables
from corvane.streaming import twins


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


def test_white_space_is_unicode(spark):
    text = " 　 a\tb \n"
    assert one(spark, T.trim_all(F.col("t")), t=text) == "a\tb" and one(spark, T.without_space(F.col("t")), t=text) == "ab"


@pytest.mark.parametrize(("n", "want"), [(14, 0), (15, 1), (16, 2)])
def test_ngrams_of_short_texts(spark, n, want):
    assert len(one(spark, T.ngrams(F.col("t"), 15), t="x" * n)) == want
    assert one(spark, T.ngrams(F.col("t"), 5, whole_if_short=True), t="abc") == ["abc"]


def test_collapse_rules(spark):
    r = random.Random(1)
    varied = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    cases = {"": "empty", "a" * 30: "max_run", "a" * 29 + varied: None, "abababababababababababababab" * 3: "char_diversity", "abcdefghij" * 8: "ngram_distinct"}
    cases["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4 + "0123456789") for _ in range(1200))] = None
    for text, want in cases.items():
        got = one(spark, T.collapse_reason(F.col("t")), t=text)
        assert got == want, text[:20]
    assert one(spark, T.collapse_reason(F.col("t")), t="".join(chr(0x100 + r.randrange(300)) for _ in range(3200))) == "long_low_diversity"


def test_json_scores(spark):
    clamp = lambda raw: one(spark, scores.clamp(F.from_json(T.flat_json(F.col("t")), "map<string,string>")["q1"]), t=raw)
    assert [clamp(x) for x in ('{"q1": 9}', 'so {"q1": 3} end', '{"q2": 1}', "none", '{"q1": "x"}')] == [5, 3, 1, 1, 1]
    assert one(spark, T.json_from_first_brace(F.col("t"), "a struct<b:int>"), t='x {"a": {"b": 2}} rest').a.b == 2
    assert one(spark, scores.valid(F.col("t")), t="9") is False and one(spark, scores.valid(F.col("t")), t="5") is True


def test_loose_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 7.0)], "x double, y double")
    assert abs(df.agg(scores.loose_correlation(F.col("x"), F.col("y"))).first()[0] - 0.629940788) < 1e-9
    assert df.limit(1).agg(scores.stdev(F.col("x"))).first()[0] == 0.0


def test_split_sizes(spark):
    rows = [(f"s{n}", k, n * 1000 + k) for n in (4, 5, 10, 30, 50, 70) for k in range(n)]
    df = split.stratified_split(spark.createDataFrame(rows, "s string, score int, id int"), ["s"], "score", "id")
    got = {r["s"]: r["c"] for r in df.groupBy("s").agg(F.count_if(F.col("split") == "eval").alias("c")).collect()}
    assert got == {"s4": 0, "s5": 1, "s10": 1, "s30": 2, "s50": 2, "s70": 4}
    assert df.where("split = 'eval' and s = 's70'").agg(F.max("score")).first()[0] == 3


def test_greedy_removal(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.4)], "id long, score double")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "i long, j long, similarity double")
    assert sorted(r["removed"] for r in dedup.greedy_removed(rows, edges, "id", "score").collect()) == [0, 2]
    r = random.Random(3)
    score = [r.randrange(4) / 2 for _ in range(40)]
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(60)})
    removed = set()
    for i in range(40):
        if i in removed:
            continue
        for a, j in pairs:
            if a == i and j not in removed:
                removed.add(i if score[i] < score[j] else j)
    got = dedup.greedy_removed(spark.createDataFrame(list(enumerate(score)), "id long, score double"), spark.createDataFrame([(*p, 1.0) for p in pairs], "i long, j long, similarity double"), "id", "score")
    assert {x["removed"] for x in got.collect()} == removed


def test_minhash_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals"
    rows = spark.createDataFrame([(0, base), (1, base + "!"), (2, "something else entirely, with other words in it"), (3, base)], "id long, t string")
    assert {(r["i"], r["j"]) for r in dedup.minhash_pairs(rows, "id", "t", "t").collect()} == {(0, 1), (0, 3), (1, 3)}
    m = rows.select(dedup.minhash(F.col("t")).alias("m")).collect()
    assert len(m[0]["m"]) == 128 and m[0]["m"] == m[3]["m"]


def test_signatures_of_pairs(spark, monkeypatch):
    """The same numbers as Spark's, of strings of all lengths; only texts in pairs are signed, each copy's class once."""
    import random

    r = random.Random(5)
    texts = ["a", "äb", "한국", "😀é한a", "abcde", "😀" * 9, *("".join(r.choice("abcé한😀z") for _ in range(k)) for k in (5, 8, 40, 300, 9000))]
    m = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").select("id", dedup.minhash(F.col("t")).alias("m"))
    assert all(list(dedup.signature(texts[x["id"]])) == x["m"] for x in m.collect())
    base = [r.choice("abcdefgh") + str(r.randrange(100)) for _ in range(80)]
    near = [" ".join(base), " ".join(base), "".join([*base[:40], "x", *base[41:]]), "*" + " ".join(base) + "*", *(str(r.random()) * 3 for _ in range(20))]
    rows = spark.createDataFrame([(i, t, "q" * 9) for i, t in enumerate(near)], "id long, t string, q string")
    signed = spark.sparkContext.accumulator(0)
    real = dedup.signature
    monkeypatch.setattr(dedup, "signature", lambda t: (signed.add(1), real(t))[1])
    got = dedup.minhash_pairs(rows, "id", "q", "t", 0.8).collect()
    marks = {x["id"]: x["m"] for x in rows.select("id", dedup.minhash(F.col("t")).alias("m")).collect()}
    assert {(x["i"], x["j"]) for x in got} == {(i, j) for j in range(4) for i in range(j)} and len(got) == 6
    assert all(x["estimate"] == sum(a == b for a, b in zip(marks[x["i"]], marks[x["j"]])) / 128 for x in got)
    assert min(x["estimate"] for x in got) < 1 and signed.value == 2


def test_minhash_pairs_against_exact_jaccard(spark):
    """At 0.5, where most pairs are far from copies; and both texts count."""
    import random

    sets = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    r = random.Random(3)
    texts = []
    for _ in range(8):
        start = [r.choice("abcdefghij") + str(r.randrange(1000)) for _ in range(80)]
        texts += ["".join(w if r.random() > share else f"x{r.randrange(10**4)}" for w in start) for share in (0, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2)]
    grams = [sets(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(grams[i], grams[j]) >= 0.5}
    assert sum(jaccard(grams[i], grams[j]) < 0.7 for i, j in want) > 20
    rows = spark.createDataFrame([(i, t, "the same answer") for i, t in enumerate(texts)], "id long, t string, v string")
    for text, verify in (("t", "t"), ("t", "v"), ("v", "t")):
        assert {(x["i"], x["j"]) for x in dedup.minhash_pairs(rows, "id", text, verify, 0.5).collect()} == want


def test_dense_pairs_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((60, 6))
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, e array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.7}
    assert {(r["i"], r["j"]) for r in dedup.dense_pairs(rows, "id", "e", 0.7, block=16).collect()} == want


def test_last_duplicate_wins_and_null_safe_resume(spark):
    left, right = spark.createDataFrame([("a",), ("z",)], "k string"), spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "rk string, v string, o int")
    assert {(r["k"], r["out"]) for r in curate.lookup_last(left, "k", right, "rk", "v", "o", "out").collect()} == {("a", "y"), ("z", "")}
    work = spark.createDataFrame([("a", None), ("a", 1), (None, None)], "k string, n int")
    assert [tuple(r) for r in curate.remaining(work, work.where("n is null"), ["k", "n"], null_safe=True).collect()] == [("a", 1)]


def test_numbering_is_global(spark):
    got = curate.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7), ["x"], start=5).collect()
    assert all(r["ordinal"] == r["x"] + 5 for r in got) and len(got) == 1000


def test_first_maximum_wins(spark):
    stats = spark.createDataFrame([("b", 0.5, 3.0), ("a", 0.5, 3.0)], "model_tag string, mean double, q3_mean double")
    assert evaluate.best_model(stats, ["b", "a"]).first()["model_tag"] == "b"


def test_segments(spark):
    lines = ["contents", "BOOK FIRST", "", "            1.", "alpha", "beta", "            2.", "gamma", "BOOK SECOND", "            3.", "delta", "APPENDIX", "            4.", "no"]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(lines)], "book string, line_no int, line string")
    got = [(r["part"], r["aph_num"], r["text_en"]) for r in segment.passages(df, segment.PROFILES["JW"]).orderBy("line_start").collect()]
    assert got == [(1, 1, "alpha\nbeta"), (1, 2, "gamma"), (2, 3, "delta")]
    pad = ["x"] * 200
    lines = [*pad, "PREFACE", "whole text", "WHY I AM SO WISE", "1. inline one", "2", "two", "1.", "again"]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(lines)], "book string, line_no int, line string")
    got = [(r["chapter_title"], r["sub_chapter"], r["aph_num"], r["text_en"]) for r in segment.passages(df, segment.PROFILES["EH"]).orderBy("line_start").collect()]
    assert got == [("PREFACE", 0, 1, "whole text"), ("WHY I AM SO WISE", 0, 1, "1. inline one"), ("WHY I AM SO WISE", 0, 2, "two"), ("WHY I AM SO WISE", 1, 1, "again")]


@pytest.mark.parametrize("work", ["TI", "EH"])
def test_scans_of_books_carry_no_text(spark, monkeypatch, work):
    """Marks run along the lines; texts move once they are known to be kept. An empty passage counts no reset."""
    seen = []
    for name in ("scanned", "neighbours"):
        real = getattr(segment, name)
        monkeypatch.setattr(segment, name, lambda rows, *a, real=real, **k: (seen.append(set(rows.columns)), real(rows, *a, **k))[1])
    lines = ["x"] * 200 + ["", "PREFACE", "", "2. two", "more", "", "1", " ", "3", "three"]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(lines)], "book string, line_no int, line string")
    got = [(r["sub_chapter"], r["aph_num"], r["text_en"], r["line_start"], r["line_end"]) for r in segment.passages(df, segment.PROFILES[work]).orderBy("line_start").collect()]
    sub = 0 if work == "EH" else None
    assert got == [(sub, 2, "2. two\nmore", 203, 206), (sub, 3, "three", 208, 210)]
    assert seen and not any(x & {"line", "text_en"} for x in seen)


@pytest.mark.parametrize("work", ["TI", "EH"])
def test_rows_of_lines_are_not_sent(spark, monkeypatch, work):
    """Marks and places compress to almost nothing; they aren't sent to all tasks for that."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = segment.neighbours
    monkeypatch.setattr(segment, "neighbours", lambda *a: (out := real(*a), plans.append(plan(out)))[0])
    lines = ["x"] * 200 + ["", "PREFACE", "", "1", "one", "2", "two"]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(lines)], "book string, line_no int, line string")
    made = segment.passages(df, segment.PROFILES[work])
    assert len(plans) == (work == "TI") and not any("BroadcastExchange" in x for x in plans)
    # Of the scan for resets one row for each partition is sent.
    assert plan(made).count("BroadcastHashJoin") == (work == "EH") and plan(made).count("SortMergeJoin") == 2
    assert [r["text_en"] for r in made.orderBy("line_start").collect()] == ["one", "two"]


def test_resets(spark):
    df = spark.createDataFrame([("b", k, n) for k, n in enumerate([1, 2, 3, 1, 2, 1])], "book string, line_no int, n int")
    assert [r["sub_chapter"] for r in segment.with_resets(df, "n").orderBy("line_no").collect()] == [0, 0, 0, 1, 1, 2]


def test_knn_toy(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.9, 0.1, 0.0])], "id long, embedding array<float>")
    got = retrieve.knn(rows, rows.where("id = 0"), 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 2, 1] and abs(got[1]["distance"] - 0.02**0.5) < 1e-6
    assert [r["id"] for r in retrieve.knn(rows, rows.where("id = 0"), 2, metric="cosine").orderBy("rank").collect()] == [0, 2]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query int, id int, rank int")
    x, y = (sorted(tuple(r) for r in retrieve.fuse(p, q, 3).collect()) for p, q in ((a, b), (b, a)))
    assert x == y and retrieve.fuse(a, b, 1).first()["id"] == 2


def test_vector_table(spark, tmp_path):
    store = tables.VectorTable(spark, f"{tmp_path}/v", 2)
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    store.insert(rows)
    store.insert(rows)
    assert store.count() == 2
    store.clear()
    assert store.count() == 0
    with pytest.raises(Exception, match="expected 2 dimensions"):
        store.insert(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"))


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/x"
    jsonl.write(spark.createDataFrame([(1, None)], "id int, split string"), path)
    assert '"split":null' in spark.read.text(path).first()["value"]
    with pytest.raises(FileNotFoundError):
        jsonl.read_required(spark, path + "-missing", "id int")
    assert jsonl.read_optional(spark, path + "-missing", "id int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{bad\n')
    with pytest.raises(Exception):
        jsonl.read_strict(spark, f"{tmp_path}/bad.jsonl", "id int").collect()
    (tmp_path / "lines.txt").write_text("a\n\nb")
    assert [(r["line_no"], r["line"]) for r in jsonl.read_lines(spark, f"{tmp_path}/lines.txt").orderBy("line_no").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert jsonl.read_directory(spark, str(tmp_path), "id int", "bad.jsonl").select("file").distinct().first()["file"] == "bad.jsonl"


def test_renderers(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, x double")
    assert "| a | 1.500 |" in render.render(df, "t", "markdown") and "--" in render.render(df, "t")
    assert render.render(df, "t", "csv").splitlines()[0] == "name,x" and '"headers"' in render.render(df, "t", "json")
    assert render.render(df, "t", "all").count("name") >= 4


def test_reports_of_files(spark, tmp_path):
    schema = "sample_id long, model_tag string, score double, q1 int, q2 int, q3 int, collapsed boolean, q3_reason string"
    rows = spark.createDataFrame([(1, "m0", 0.25, 1, 2, 3, False, "ends '~a'"), (2, "m0", 0.5, 3, 2, 3, True, "ends '~b'"), (3, "m1", 1.0, 5, 5, 5, False, "ends '~b'")], schema)
    jsonl.write(rows, f"{tmp_path}/in")
    shown = evaluate.run_report(spark, "q-distribution", f"{tmp_path}/in", schema, "markdown", 1, top=3)
    assert "| m0 | q1 | 2 | 2.0 |" in shown
    ends = lambda **o: {r["ending"]: r["n"] for r in evaluate.ending_top(rows, F.col("q3_reason"), 5, **o).collect()}
    assert (ends(), ends(models=["m0"]), ends(live=True)) == ({"~a": 1, "~b": 2}, {"~a": 1, "~b": 1}, {"~a": 1, "~b": 1})
    both = {r["model_tag"]: r for r in evaluate.compare_modes(rows, rows.where("model_tag = 'm1'"), ("q3",)).collect()}
    assert (both["m0"]["q3_mean_a"], both["m0"]["q3_mean_b"], both["m0"]["q3_delta"], both["m1"]["q3_delta"]) == (3.0, 0.0, -3.0, 0.0)


def test_dialogue_reducer():
    s = dict(twins.START)
    for kind in ("booting", "start", "done", "user", "start", "error"):
        s = twins.dialogue(s, kind)
    assert s == {"status": "idle", "user_turns": 1, "messages": 2, "open": False, "error": "error"}
    p = twins.panel(twins.panel(dict(twins.START), "user", "one"), "user", "two")
    assert p["messages"] == 1 and p["screen"] == "two"


def test_dialogue_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "system"), (2, 1, "user")], "conv_id long, turn long, role string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = twins.dialogue_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "conv_id", "turn")
    stream.writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, twins.dialogue_states(rows, "conv_id", "turn").collect()))


def test_history_of_short_conversations(spark):
    rows = spark.createDataFrame([(c, t, f"{c}-{t}") for c, n in ((1, 3), (2, 8)) for t in range(n)], "c int, t int, text string")
    got = {r["c"]: r["n"] for r in sessions.last_messages(rows, "c", "t", 6).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 3, 2: 6}


def test_scorer_failures_become_nulls(spark):
    def broken(prompts):
        raise RuntimeError("model is down")

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")
    got = plugins.score(rows, "id", "p", plugins.with_retries(broken, 2, 0.01), concurrency=2).collect()
    assert len(got) == 2 and all(r["q1"] is None for r in got)
    assert all(1 <= r["q2"] <= 5 for r in plugins.score(rows, "id", "p").collect())


def test_commands(spark):
    with pytest.raises(KeyError):
        evaluate.run_command("nothing", spark.range(1))
    cols = "sample_id long, model_tag string, voice string, pattern string, generated string, generated_len long, collapsed boolean, collapse_reason string, q1 int, q2 int, q3 int, q1_reason string, q2_reason string, q3_reason string, score double, grade string"
    rows = spark.createDataFrame(
        [
            (1, "m0", "v", "p", "aaa", 3, False, None, 3, 4, 1, "ends on '~x'", "dull tone", None, 0.5, "C"),
            (1, "m1", "v", "p", "bbbb", 4, False, None, 4, 4, 5, "fine", "fine", "dull", 0.9, "A"),
            (2, "m0", "v", "q", "", 0, True, "empty", None, None, None, None, None, None, 0.0, "F"),
            (3, "m0", "v", "p", "cc", 2, False, None, 5, 5, 2, "good", "good", "good", 0.8, "B"),
        ],
        cols,
    )
    options = dict(models=["m0", "m1"], threshold=2, top=3, n=1, keywords=["dull"], model="m0", a="voice", b="pattern", values=["p"], texts=rows, condition=F.col("grade") == "C", reason=F.col("q1_reason"))
    got = {}
    for name in evaluate.COMMANDS:
        pair = {"compare-modes": evaluate.compare_modes, "agreement": evaluate.agreement}.get(name)
        got[name] = (pair(rows, rows) if pair else evaluate.run_command(name, rows, **options)).collect()
        assert got[name], name
    assert {(r["sample_id"], r["model_tag"], r["axis"]) for r in got["reason-search"]} == {(1, "m0", "q2"), (1, "m1", "q3")}
    assert len(evaluate.run_command("reason-search", rows, keywords=["dull", "good"], axes=("q3",), limit=1).collect()) == 1
    assert [(r["pattern"], round(r["delta"], 6)) for r in got["per-pattern-defect"]] == [("p", 0.25)]
    assert [r["low"] for r in got["voice-defect"]] == [2]


def test_two_rules_of_removal(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([0.5, 0.9, 0.4, 0.7, 0.6, 0.3])], "id long, s double")
    pairs = lambda *x: spark.createDataFrame(x, "i long, j long, similarity double")
    edges = dedup.rule_edges(pairs((1, 3, 0.95), (3, 4, 0.86), (4, 5, 0.9)), pairs((3, 4, 0.93), (4, 5, 0.91)))
    assert {tuple(r) for r in edges.collect()} == {(1, 3, "answer"), (3, 4, "question_answer")}
    got, _ = dedup.removed_by_rules(rows, "id", "s", pairs((0, 1, 1.0), (0, 2, 1.0)), edges)
    assert {tuple(r) for r in got.collect()} == {(0, "surface"), (2, "surface"), (3, "answer")}


# --- overlap with protected text ---
@pytest.mark.parametrize("chars", [curate.BROADCAST_CHARS, 0])
def test_overlap_against_plain_windows(spark, monkeypatch, chars):
    """Both ways, by windows in the tasks and by a join, against sets of windows; null, short and astral texts."""
    monkeypatch.setattr(curate, "BROADCAST_CHARS", chars)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abé🙂") for _ in range(n))
    bad = [word(40), word(15), word(14), None, ""]
    texts = [None, "", word(14), word(60), bad[0][3:18], bad[0][3:17], "x" * 30 + bad[1] + "y", "*" + bad[0][:20] + "* z", word(300)]
    squeeze = lambda t: re.sub(r"\s+", "", re.sub(r"\*([^*]*)\*", r"\1", t or ""))
    grams = lambda t: {t[i : i + 15] for i in range(len(t) - 14)}
    wanted = {i for i, t in enumerate(texts) if grams(squeeze(t)) & set().union(*(grams(squeeze(b)) for b in bad))}
    docs, protected = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(b,) for b in bad], "t string")
    assert {x["id"] for x in curate.overlapping(docs, protected, "id", "text", "t").collect()} == wanted
    assert curate.with_overlap(docs, protected, "id", "text", "t").where("shares is null").count() == 0
    assert curate.overlapping(docs, protected.limit(0), "id", "text", "t").count() == 0
    # Null and repeated keys tell nothing about texts.
    same = spark.createDataFrame([(k, t, "x") for t in texts for k in (1, None)], "id long, text string, shares string")
    got = curate.with_overlap(same, protected, "id", "text", "t")
    assert got.columns == ["id", "text", "shares"] and got.count() == 2 * len(texts)
    assert all(x["shares"] == (texts.index(x["text"]) in wanted) for x in got.collect())
