"""URL rules, periodic runs and whitening against plain restatements."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import periodic, urls, whitening


# --- 11 ---
def plain_verdict(url, rules, default="allow"):
    head, sep, tail = (url or "").partition("://")
    cut = min((tail.find(c) for c in "/?#" if c in tail), default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:cut])
    path = tail[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len((h + p).encode()), len(h), h + p, v) for h, p, v in rules if sep and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


RULES = [*urls.BASE, ("example.org", "/es/12", "allow"), ("a.example.org", "", "block"), ("é.fr", "/ü", "block"), ("b.c", "/x/y/z", "block"), ("c", "/x/y/zz", "allow"), ("localhost", "", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://ORG?x=/", "https://x.example.org/es/1", "https://x.example.org/es/123#top", "https://example.org/en/1", "https://example.org/en/2",
    "https://notexample.org/es/", "http://a.example.org", "http://b.a.EXAMPLE.org/es/12?q", "http://com/de", "http://x.com/de/", "http://x.com/fr/?/de/", "http://x.É.fr/ü", "http://x.é.fr/üb", "http://user@h.com:80/de/", "a://b://com/de/", "http://b.c/x/y/zz",
    "http://.org/", "http://org./", "http://a\nb.org/x\ny", "//x.org/", "http://localhost:8080/", "http://localhost/", "http://x.com/fr/" + "y" * 50_000,
]


@pytest.mark.parametrize("shard_rows", [4_000_000, 2])
def test_urls(spark, shard_rows):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    listed = urls.rule_list(spark.createDataFrame([*RULES, (None, "/", "block"), ("", "/", "block"), ("com", "/q/", None)], "host string, path string, verdict string").repartition(3), shard_rows)
    assert len(listed.rules.shards) == (1 if shard_rows > 100 else len(listed.rules.shards)) and (shard_rows > 100 or len(listed.rules.shards) > 2)
    got = urls.with_verdicts(pages, listed).collect()
    assert len(got) == len(URLS) * 2 and got[0].__fields__ == ["page_id", "url", "host", "verdict", "__url__"]
    for r in got:
        assert tuple(r["__url__"]) == plain_verdict(r["url"], RULES), r["url"]
        assert (r["host"], r["verdict"]) == ("h", "v")
    assert urls.report(pages.limit(0)).count() == 0
    empty = urls.rule_list(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {tuple(r["__url__"])[2:] for r in urls.with_verdicts(pages, empty, default="block").collect()} == {(None, "block")}
    assert urls.report(pages.drop("host").withColumn("html", F.lit(None).cast("string"))).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_digests_that_collide(tmp_path):
    """Equal digests of different strings: the stored string decides."""
    name = b"example.org/es/"
    digest = urls.xxhash.xxh64_intdigest(name, urls.SEED)
    stored = [b"other/\nallow", name + b"\nblock", b"third/\nallow"]
    (tmp_path / "s.digests").write_bytes(np.full(3, digest, dtype=np.uint64).tobytes())
    (tmp_path / "s.ends").write_bytes(np.cumsum([len(x) for x in stored]).astype(np.uint64).tobytes())
    (tmp_path / "s.strings").write_bytes(b"".join(stored))
    array = urls.DigestArray([urls.Shard(digest, digest, f"file://{tmp_path}/s")])
    assert array.find([name, b"unknown", b"other/"]) == [b"block", None, None]


# --- 12 ---
def plain_runs(words, least=6, repeats=4):
    n, found = len(words), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            low = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - low >= max(least, repeats * p):
                found.setdefault((low, i + p - low), p)  # the smallest period comes first
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_texts():
    r = random.Random(5)
    texts = [None, "", " \t\r\n\x0b\x0c ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", " ".join("ab" * 40 + "c" + "ab" * 9), "a\u00a0b " * 8, "x\x85y " * 8]
    for k in range(150):
        out = []
        for _ in range(r.randrange(1, 8)):
            unit = [r.choice("abcd"[: r.randrange(1, 5)]) for _ in range(r.randrange(1, 9))]
            out += unit * r.choice([1, 1, 2, 4, 5, 9, 40]) + unit[: r.randrange(len(unit))]
        texts.append(r.choice(" \n\t").join(out))
    texts += [" ".join(r.choice("ab") for _ in range(n)) for n in (300, 1500)] + [" ".join(["a"] * 3000), " ".join(f"w{k % 613}" for k in range(4000))]
    return texts


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_periodic_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    texts = runs_texts()
    found = periodic._runs(periodic.pa.array(texts, periodic.pa.string())).to_pylist()
    for t, f in zip(texts, found):
        words = [w.decode() for w in (t or "").encode().split()]
        want = plain_runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in f["runs"]] == want, t
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert (f["n_words"], f["collapsed"]) == (len(words), " ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_report(spark):
    texts = runs_texts() + [" ".join(f"w{k}" for k in range(n)) for n in range(1, 120)]
    ids = [None, *range(1, len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)] + [(3, texts[3], "x", 1)], "doc_id long, text string, __runs__ string, n_runs int")
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in periodic.report(docs).collect()}
    assert periodic.report(docs).count() == len(texts) + 1 and periodic.report(docs.limit(0)).count() == 0
    planted = 0
    for i, t in zip(ids, texts):
        plain = [w.decode() for w in (t or "").encode().split()]
        words = plain_planted(i, plain)
        planted += words != plain
        runs = plain_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        row = got[i, hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *(best or (None,) * 3))
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    assert planted > 10
    kept = periodic.with_runs(docs, added="__found__")
    assert kept.columns == [*docs.columns, "__found__"]


# --- 13 ---
def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    r = np.random.default_rng(3)
    rows = (r.normal(size=(700, 12)) @ r.normal(size=(12, 12)) + 5).astype(np.float32).astype(float).tolist()
    bad = [None, [], [math.nan] + [0.0] * 11, [math.inf] + [0.0] * 11, [None] + [0.0] * 11, [1.0, 2.0]]
    given = [(i, v, "x") for i, v in enumerate(rows + bad)] + [(None, rows[0], "x")]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, component string").repartition(7)
    got = whitening.report(df).collect()
    x = np.floor(64 * np.array(rows + [rows[0]])).astype(int) + 1_000_000
    n, d = x.shape
    sums = [int(s) for s in x.sum(0)]
    exact = [[Fraction(int(v)) - Fraction(s, n) for v, s in zip(row, sums)] for row in x]
    centred = np.array([[float(v) for v in row] for row in exact])
    cov = np.array([[float(sum(row[a] * row[b] for row in exact) / n) for a in range(d)] for b in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes / np.sqrt(values)
    assert len(got) == n * d
    by = {(q["vec_id"], q["component"]): q for q in got}
    sign = np.sign([by[0, c + 1]["whitened"] * want[0, c] for c in range(d)])
    for i in range(n):
        key = i if i < len(rows) else None
        dev = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
        for c in range(d):
            q = by[key, c + 1]
            assert (q["n"], q["deviation"]) == (n, dev)
            assert abs(q["whitened"] - sign[c] * want[i, c]) < 1e-9 and abs(q["explained"] - values[c] / np.trace(cov)) < 1e-12
            assert q["identity_error"] < 1e-7
    assert whitening.fit(df, components=3).eigenvalues.shape == (3,)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, n string"
    assert whitening.report(spark.createDataFrame([], schema)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None, "x"), (2, [math.nan], "x")], schema)).count() == 0
    one = whitening.report(spark.createDataFrame([(1, [0.5, 0.5], "x")], schema)).collect()
    assert [tuple(q) for q in one] == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.report(spark.createDataFrame([(i, [float(i), 2.0], "x") for i in range(9)], schema)).collect()
    assert all(q["whitened"] is None for q in flat if q["component"] == 2) and all(q["identity_error"] < 1e-7 and q["whitened"] is not None for q in flat if q["component"] == 1)
    huge = whitening.report(spark.createDataFrame([(i, [float(3e38) * (-1) ** i, float(i)], "x") for i in range(9)], schema)).collect()
    assert {q["deviation"] for q in huge} == {None} and len(huge) == 18


def test_chan_merging_in_any_order():
    r = np.random.default_rng(1)
    rows = r.integers(999_000, 1_001_000, size=(500, 5))
    parts = [whitening.moments(rows[a:b]) for a, b in ((0, 1), (1, 200), (200, 203), (203, 500))]
    whole = whitening.moments(rows)
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        m = parts[order[0]]
        for k in order[1:]:
            m = m.merged(parts[k])
        assert (m.n, m.sums) == (whole.n, whole.sums) and np.allclose(m.scatter, whole.scatter, rtol=1e-12, atol=1e-3)
