"""Each training-data operator against a plain restatement, on edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns."""

import base64
import collections
import hashlib
import io
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, common, decontam, langid, licenses, line_dedup, ngram_join, pii, quality, warc

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, n_words string, spans string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, texts, lang="en"):
    """Documents with extra columns whose names clash with columns of operators."""
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, t in enumerate(texts)], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(vocabulary)}" for _ in range(n))


EDGES = [None, "", " \n\t ", "word", "é ß 漢字 🙂 a", prose(1, 4000), "same text here", "same text here"]


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(common, "PART_ROWS", 1)
    keys = [1] * 40 + [2] * 30 + [3, 4, 4, 5] + [None] * 9
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    counted = collections.Counter(k for k in keys if k not in (None, 5))
    facts = spark.createDataFrame([(k, n, f"f{k}") for k, n in counted.items()], "k long, n long, f string")
    for how in ("inner", "left"):
        got = common.spread_join(rows, facts, "k", "n", len(keys), how)
        assert got.columns == ["k", "i", "f"]
        want = [(k, i, f"f{k}" if k in counted else None) for i, k in enumerate(keys) if how == "left" or k in counted]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert common.spread_join(rows.limit(0), facts.limit(0), "k", "n", 0).count() == 0


# --- 1 ---
def test_license_scan(spark):
    texts = EDGES + [
        "GNU General Public License and MIT License; apache  license, CC-BY",
        "the gnu general public licence",
        "Licensed under the Apache License, Version 2.0. apache license",
        "mit license " * 3,
    ]
    got = {r["doc_id"]: r for r in licenses.report(docs_of(spark, texts)).collect()}
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    for i, t in enumerate(texts):
        words = WORDS.findall(low(t))
        places = [(k, name) for name, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got[i]["base_labels"] == ",".join(sorted({n for _, n in places}))
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) or not places
        assert 0 <= got[i]["score"] <= 1
    assert got[len(EDGES) + 2]["labels"] == "apache,apache-2.0"
    assert licenses.report(docs_of(spark, [])).count() == 0


def test_license_placements_are_whole(spark):
    """Every placement counts, wherever the template's other words stand: notices with other words against all places."""
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    inexact = notice.replace("person", "individual")
    r = random.Random(9)
    texts = [f"a person {inexact} end", inexact, f"{inexact} {notice}", *(t.label for t in licenses.TEMPLATES)]
    for t in licenses.TEMPLATES * 8:
        words = [w.decode() for w in t.words]
        for k in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"x{k}"
        around = [w.decode() for w in r.sample(r.choice(licenses.TEMPLATES).words, 2)]
        texts.append(" ".join([*around, *words[r.randint(0, 1) :], "and", *r.sample([w.decode() for w in t.words], 1), *words]))
    texts += ["a person of note"] * 3
    got = {x["doc_id"]: x["places"] for x in licenses.scan(docs_of(spark, texts).select("doc_id", "text")).collect()}
    for k, text in enumerate(texts):
        words, want = [w.encode() for w in WORDS.findall(low(text))], set()
        for t in licenses.TEMPLATES:
            for at in range(-len(t.words), len(words)):
                here = [words[at + i] if 0 <= at + i < len(words) else None for i in range(len(t.words))]
                same = [a == b for a, b in zip(here, t.words)]
                if all(all(same[s : s + n]) for s, n in t.keys) and sum(same) / len(same) >= t.share:
                    want.add((t.label, max(at, 0)))
        assert {(p["label"], p["start"]) for p in got[k]} == want
    assert [p["label"] for p in got[0]] == ["mit-notice"] and [p["label"] for p in got[2]] == ["mit-notice"] * 2


# --- 2 ---
def counts(t):
    ws = re.compile("[^\x20\x09-\x0d]+")
    w = ws.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if ws.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_counts(spark):
    texts = EDGES + ["a b c d e a b c d e", "a a a a a a a a a a a a", "x\n\nx\n x\nx\ny\ny", "#|# <b> 100% $&*", "a\x0bb\x0cc\rd", "a b c d e f g a b c d e x a b c d e"]
    rows = quality.judge(docs_of(spark, texts), []).collect()
    for r in rows:
        want = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(docs_of(spark, []), []).count() == 0


def test_quality_learns_threshold(spark):
    good = [prose(i, 80) for i in range(150)]
    bad = [re.sub(r" ", "%%% ", prose(1000 + i, 80)) for i in range(150)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert rules and all(r.conditions for r in rules)
    kept = {r["doc_id"] for r in quality.report(docs, labels).where("kept").collect()}
    assert kept <= set(range(150)) and len(kept) >= 147
    assert quality.fit(docs, labels.where("quality = 1")) == []


# --- 3 ---
def contaminated_words(text, items):
    words, hit, found = WORDS.findall(low(text)), set(), set()
    for item, t in items:
        w = WORDS.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(words), len(hit), found


def test_decontamination(spark, monkeypatch):
    long = prose(7, 60, 50)
    items = [(1, long), (2, "Short Item"), (10, "one"), (3, ""), (4, None), (5, long), (6, prose(8, 30, 5))]
    body = long.split()
    texts = EDGES + [
        prose(9, 200) + " " + " ".join(body[10:40]) + " " + prose(10, 50),
        "short, item! short item short",
        " ".join(body[:12]),
        " ".join(body[:13] + body[:13]),
        " ".join(body * 3),
        "ONE",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block, shard in ((8 << 20, 2_000_000), (200, 50)):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontam, "SLICE_BYTES", 40 if shard == 50 else 1 << 20)
        monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
        got = {r["doc_id"]: r for r in decontam.report(docs_of(spark, texts), bench).collect()}
        for i, t in enumerate(texts):
            n, hit, found = contaminated_words(t, [(a, b) for a, b in items if b])
            ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(found), ids), i
            assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert decontam.report(docs_of(spark, EDGES), bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index_finds_all_places():
    import numpy as np

    r = np.random.default_rng(3)
    text = r.integers(1, 5, 500).astype(np.int32)
    index = decontam.FMIndex(text, 6)
    for n in (1, 2, 5):
        patterns = np.array([text[k : k + n] for k in range(0, 400, 37)] + [[5] * n])
        rows, lo, hi = index.search(patterns)
        found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(rows, lo, hi)}
        for k, p in enumerate(patterns):
            assert found.get(k, []) == [x for x in range(len(text) - n + 1) if (text[x : x + n] == p).all()]


# --- 4 ---
BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 13 <= len(d := re.sub("[ -]", "", v)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in p.finditer(t or "") if ok(m.group())]


def test_personal_data(spark):
    r = random.Random(5)
    texts = EDGES + [
        "🙂 mail a.b+c@x-y.example.org, c@d.e@f.g.h x@y @z.w a@b..c",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1.2.3 9.9.9.9",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111-",
        "+1 (778) 555-8933 +1+2 +49.30.1234567-x +12345678901234567",
        "a" * 3000 + "@" + "b" * 3000 + ".c" * 2000,
        "9" * 4000,
        *["".join(r.choice("a1.@+- (4)") for _ in range(400)) for _ in range(12)],
        *[f"note password={r.randrange(16**17):018x}f ok" for _ in range(40)],
        *[f'set token = "{r.randrange(16**39):039x}f" ok' for _ in range(40)],
    ]
    for row in pii.report(docs_of(spark, texts)).collect():
        t = texts[row["doc_id"]]
        want = base(t)
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, row["spans"])
        assert row["spans"].startswith(",".join(want))
        assert [row[f"n_{k}"] for k, _, _ in BASE] == [sum(x.startswith(k) for x in want) for k, _, _ in BASE]
        if t and "password=" in t and re.search("[a-f]", t.split("=")[1][:18]):
            assert "id:14:" in row["spans"]
    assert pii.report(docs_of(spark, [])).count() == 0


def test_pii_all_patterns_and_numbers(spark, monkeypatch):
    """Every accepted context finds its identifiers, also numbers, however few patterns are held as literals."""
    r = random.Random(8)
    contexts = ["token=", 'secret: "', "apikey -> ", "login=(", "pass: ["]
    texts = EDGES + [f"note {c}{r.randrange(16**39):039x}f ok" for c in contexts for _ in range(20)]
    texts.append(" ".join(f"Lot{k}Qw{k}x" for k in range(100, 140)))  # so that this shape alone isn't accepted
    first = len(texts)
    texts += [f"note {c}{v} ok {v}" for c in contexts for v in ("Zx91kQ77pL", "40718263")] + ["order 40718263 ok"]

    def spans():
        return {x["doc_id"]: x["spans"] for x in pii.report(docs_of(spark, texts)).collect()}

    whole = spans()
    for i in range(first, len(texts) - 1):
        at = re.search("Zx91kQ77pL|40718263", texts[i])
        assert whole[i] == f"id:{at.start()}:{at.end()}"
    assert whole[len(texts) - 1] == ""
    monkeypatch.setattr(pii, "PATTERNS", 1)
    assert spans() == whole
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert spans() == whole


# --- 5 ---
def test_byte_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    texts = EDGES + [
        "it's we'll I'VE  two   spaces\n\n\ttab   nbsp　wide \x85 \x1c   end ",
        "aaaa" * 300,
        "ab" * 50 + "=" * 200 + "-=" * 99,
        "<|endoftext|> a\\b \"q\" Āā",
        *["".join(r.choice("abcethé漢🙂 1.'\n") for _ in range(200)) for _ in range(10)],
    ]
    docs = docs_of(spark, texts)
    for most in (0, 4000, bpe.HELD_BYTES):
        coded = bpe.Tokenizer(spark, bpe.load_ranks(path), P.PATTERN).encode(docs, most=most)
        for row in coded.collect():
            t = texts[row["doc_id"]] or ""
            ids = own.encode_ordinary(t)
            assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids), t
            assert bytes(row["decoded"]) == t.encode()
    assert bpe.Tokenizer(spark, bpe.load_ranks(path), P.PATTERN).encode(docs_of(spark, [])).count() == 0


def test_byte_bpe_order_of_merges(spark, monkeypatch):
    """Ranks in any order, so that merges at all places of a pair at once would often differ from one after another."""
    import tiktoken

    r = random.Random(5)
    tables = [[b"aba", b"ab"], [b"aaa", b"aa"], [b"bab", b"ab", b"abab"]]
    for _ in range(4):
        made = [bytes([x]) for x in b"abc"]
        for _ in range(14):
            made.append(r.choice(made) + r.choice(made))
        made = sorted({x for x in made if 1 < len(x) < 9})
        r.shuffle(made)
        tables.append(made)
    texts = ["".join(r.choice("abc"[: r.choice((2, 3))]) for _ in range(n)) for n in (1, 2, 7, 63, 64, 65, 90, 200)] + ["ab" * 60, "a" * 133, "aab" * 40]
    monkeypatch.setattr(bpe, "BUCKETS", 64)
    for made in tables:
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(made)}
        own = tiktoken.Encoding("own", pat_str=r"\p{L}+|\s+", mergeable_ranks=ranks, special_tokens={})
        coded = bpe.Tokenizer(spark, {t.decode("latin-1"): k for t, k in ranks.items()}, r"\p{L}+|\s+").encode(docs_of(spark, texts))
        for row in coded.collect():
            ids = own.encode_ordinary(texts[row["doc_id"]])
            assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids), (made, texts[row["doc_id"]])


# --- 6 ---
def links_of(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall(low(t))
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    n, root = collections.Counter(), list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (n[i], find(i)) for i in sets}


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(4)
    start = prose(20, 150).split()
    near = []
    for k in range(25):  # a chain of texts, each a little further away
        w = list(start)
        for at in r.sample(range(len(w)), k // 4):
            w[at] = f"new{k}"
        near.append(" ".join(w))
    texts = EDGES + near + [start[0], " ".join(start).upper(), prose(21, 150)]
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in ngram_join.report(docs_of(spark, texts)).collect()}
    assert got == links_of(texts)
    stay = {x["doc_id"] for x in ngram_join.representatives(docs_of(spark, texts)).collect()}
    assert stay == {c for _, c in got.values()}
    assert ngram_join.report(docs_of(spark, [])).count() == 0


def test_ngram_join_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(common, "PART_ROWS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = prose(30, 120).split()
    near = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in range(60)]
    texts = near + [near[0]] * 40 + [None] * 20 + [prose(100 + k, 60) for k in range(30)]
    got = {x["doc_id"]: (x["n_links"], x["class_id"]) for x in ngram_join.report(docs_of(spark, texts)).collect()}
    assert got == links_of(texts)


# --- 7 ---
def test_language_id(spark):
    r = random.Random(6)
    parts = {"aa": ["the", "ing", "and", "ther"], "bb": ["que", "eau", "oui", "les"], "cc": ["sch", "ung", "ein", "der"]}
    rows = [(i, " ".join("".join(r.choices(parts[lang], k=2)) for _ in range(60)), lang) for i, lang in enumerate([*parts] * 60)]
    rows += [(1000, None, "aa"), (1001, "12 34 ½ --", "bb"), (1002, "", None), (None, rows[0][1], "aa")]
    got = {x["doc_id"]: x for x in langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got.values()) and any(x["held_out"] for x in got.values())


def test_language_id_whole_profiles(spark, monkeypatch):
    """1- to 3-grams and 400 ranks, against a plain restatement; texts longer than a chunk as well."""
    monkeypatch.setattr(langid, "CHUNK", 50)

    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            p = f"_{w}_"
            out.update([*w, *(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))])
        return out

    top = lambda counts: [g for _, g in sorted((-n, g) for g, n in counts.items())[:400]]
    r = random.Random(7)
    letters = {"aa": "abcdefghijklmnopqrst", "bb": "fghijklmnopqrstuvwxy", "cc": "ñéπж漢🙂𝒳øßaeiou"}
    rows = [(i, " ".join("".join(r.choices(letters[lang], k=r.randint(1, 9))) for _ in range(r.randint(1, 80))) + ". 7_", lang) for i, lang in enumerate([*letters] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.train(docs)
    want = {lang: top(sum((grams(t) for _, t, x in rows if x == lang), collections.Counter())) for lang in letters}
    assert {lang: sorted(p, key=p.get) for lang, p in profiles.items()} == want
    assert all(len(p) == 400 and any(len(g) == 1 for g in p) for p in want.values())
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(docs, profiles).collect()}
    for i, text, _ in rows:
        own = top(grams(text))
        if not any(c.isalpha() for c in text):
            continue
        away = {lang: sum(abs(p.index(g) - k) if g in p else 400 for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(away, key=away.get)
        assert got[i] == (best, 1 - away[best] / (400 * len(own)))


# --- 8 ---
def removed(texts, min_words=8):
    lines = [(i, k, tuple(re.findall("[^ \t-\r]+", x))) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) < min_words:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return len(b) - len(a) == 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    first = {}
    for i, k, w in lines:
        first.setdefault(w, (i, k))
    lose = {b for b in first if any(first[a] < first[b] and near(a, b) for a in first)}
    out = {i: [] for i, _, _ in lines}
    for i, k, w in lines:
        if first[w] != (i, k) or w in lose:
            out[i].append(k)
    return out


def test_line_dedup(spark):
    line = "one two three four five six seven eight nine ten"
    w = line.split()
    texts = [None, "", " \n ", f"{line}\nshort line\n\nshort line", line.replace("four", "for"), " ".join(w[1:]), " ".join(w + ["more"]), " ".join(w[2:]),
             " ".join(w[:7]), " ".join(w[:6] + ["x"]), f"a\n{line}\n  {line}  ", "漢 字 é " + line, " ".join(["same"] * 9), " ".join(["same"] * 10), "\n".join(prose(k, 12, 6) for k in range(80))]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in line_dedup.report(docs).collect()}
    want = removed(texts)
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        rest = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want.get(i, []))
        if want.get(i) and not rest.split():
            assert i not in kept
            continue
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])))
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_line_dedup_of_hot_and_short_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(common, "PART_ROWS", 2)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    r = random.Random(8)
    first = "this half is the same in all of these lines"
    texts = [f"common line\n{first} {prose(k, 8, 3)}\n{first} {r.randrange(6)}\n{prose(k % 40, r.randint(1, 4), 2)}" for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for least in (8, 1):
        found = line_dedup.removed_lines(docs, min_words=least).where("size(removed) > 0").collect()
        assert {x["doc_id"]: x["removed"] for x in found} == {i: lines for i, lines in removed(texts, least).items() if lines}
    twice = docs.union(docs)  # rows that repeat id and text, and null ids, are one document each
    assert {tuple(x) for x in line_dedup.report(twice).collect()} == {tuple(x) for x in line_dedup.report(docs).collect()}
    nameless = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(x["n_removed"] for x in line_dedup.report(docs.where("doc_id < 3").union(nameless)).where("doc_id is null").collect()) == [4, 4, 4]


# --- 9 ---
def test_warc(spark):
    big, other = "é" * 600, "b" * 999
    pages = [(1, "u1", big), (2, "u2", big), (7, "u7", big), (None, "n", big), (3, "u3", None), (4, "u4", ""), (5, None, other), (6, "u6", other), (8, "u8", "c" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.report(df).collect()))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and i != 7
        want.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want)
    assert warc.report(df.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    one = warc.record("response", "u", 1, b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    good = warc.member(one) * 2
    assert len(list(warc.read_records(io.BytesIO(good)))) == 2
    for broken in (good[:-3], warc.member(one.replace(b"abc", b"abd")), warc.member(one + b"x"), warc.member(b"no header")):
        with pytest.raises(Exception):
            list(warc.read_records(io.BytesIO(broken)))


# --- 10 ---
def test_chat_round_trip():
    turns = [("user", "</s>[INST] <|turn|>x\n<|end|>\n ␛ ␛0 ␛1"), ("assistant", "<<SYS>> a <s>"), ("odd\nrole", ""), ("assistant", "[/INST]")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count(chat.OPEN) == len(turns) and "[INST]" not in text and "</s>" not in text


def test_chat_layouts():
    cases = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"x": 1}},
        "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_response": {"prompt": "q", "response": "a"},
        "instruction": {"instruction": "q", "output": "a"},
        "nested_prompt": {"data": {"prompt": "q", "response": "a"}},
    }
    for name, record in cases.items():
        assert chat.canonical(record) == (name, [("user", "q"), ("assistant", "a")])
    assert chat.canonical({"instruction": "q", "input": "more", "output": "a"})[1][0] == ("user", "q\n\nmore")
    assert chat.canonical({"nothing": 1}) == (None, []) and chat.canonical([1]) == (None, [])


def test_chat_report(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 200, "assistant", "last"), (2, None, None, "t"), (1, 65, "system", "s"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (4, sha("user\nq\nassistant\n\nsystem\ns\nassistant\nlast\n"))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, sha("last"))
    assert got[2]["turns_sha256"] == sha("\nt\n") and got[3]["n_turns"] == 2
    assert got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]") and got[-7]["turns_sha256"] == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")


# --- pipeline ---
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    passage = prose(31, 40)
    texts = [prose(100 + k, 60) for k in range(20)]
    texts += [texts[0], texts[1].replace(" ", "  "), None, "", "too short", f"{prose(50, 30)} {passage}", "# " * 50]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(20)) <= set(out) and not {20, 21, 22, 23, 24, 25, 26} & set(out)
    assert all(out[i] == texts[i] for i in range(20))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
