"""Inputs that once crashed an operator, lost rows or took a caller's columns."""

import collections
import io
import json
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from corvane.llm import chat, decontam, pii, quality, warc


def test_urls_cant_write_headers(spark):
    url = "http://a/%41\r\nWARC-Type: revisit\r\n\r\nx\x00 \u2028 "
    one = warc.member(warc.record("response", url, 1, b"body", "02083f4579e08a612425c0c1a17ee47add783b94", 4, None))
    ((head, block),) = warc.read_records(io.BytesIO(one))
    assert head["warc-type"] == "response" and block == b"body" and warc.from_header(head["warc-target-uri"]) == url
    pages = spark.createDataFrame([(1, url, "x" * 2000), (2, "\r\n\r\n", "x" * 2000)], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.report(pages).collect()} == {1: "revisit", 2: "response"}


def test_scheme_of_hadoop_is_known():
    assert warc.arrow_uri("s3a://bucket/folder") == "s3://bucket/folder" and warc.arrow_uri("file:///tmp/x") == "file:///tmp/x"


def test_item_ids_of_any_type_and_callers_columns(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(40))
    items = spark.createDataFrame([("b-2", words), ("a", "w0 w1 w2"), (None, "w30 w31"), ("e", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, words, "S", 777), (2, "nothing here", "S", 777), (3, None, "S", 777)], "doc_id long, text string, spans string, n_words long")
    plain = {r["doc_id"]: r for r in decontam.report(docs, items).collect()}
    assert (plain[1]["n_items"], plain[1]["n_hit"], plain[2]["n_hit"], plain[3]["n_words"]) == (2, 40, 0, 0)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)  # several blocks
    assert {r["doc_id"]: r for r in decontam.report(docs, items).collect()} == plain
    added = ("__n_words__", "__spans__", "__items__")
    got = decontam.decontaminate(docs, items, added=added)
    assert {(r["spans"], r["n_words"]) for r in got.collect()} == {("S", 777)} and set(added) <= set(got.columns)
    assert decontam.report(docs.limit(0), items).count() == 0 and decontam.report(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_quality_stage_keeps_callers_columns(spark):
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "a", "b", True), (2, "few", "a", "b", True), (3, None, "a", "b", True)], "doc_id long, text string, n_words string, rule string, kept boolean")
    assert [tuple(r) for r in quality.keep(docs, []).collect()] == [(1, text, "a", "b", True)]
    assert quality.keep(docs.limit(0), []).columns == docs.columns


@pytest.mark.parametrize(
    ("value", "layout", "turns"),
    [
        ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, "messages_system", [("system", "s"), ("user", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages_parts", [("user", "ab")]),
        ({"messages": [{"role": "user", "content": "a"}], "prompt": "p"}, "messages", [("user", "a")]),
        ({"other": 1}, None, []),
    ],
)
def test_layouts_by_what_fits(value, layout, turns):
    assert chat.canonical(value) == (layout, turns)


def test_records_without_layout_are_counted(spark):
    deep = "[" * 100_000
    rows = spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, json.dumps({"prompt": "a", "response": "b"}))], "id long, record string")
    counts = {r["layout"]: r["n"] for r in chat.layout_counts(chat.format_records(rows)).collect()}
    assert counts == {None: 3, "prompt_response": 1}


def test_conversations_come_in_many_layouts(spark):
    turns = [(c, t, r, f"text {c} {t}") for c in range(60) for t, r in enumerate(["user", "assistant", "user"][: 2 + c % 2])]
    turns += [(100, 0, "system", "s"), (100, 1, "user", "u"), (100, 2, "assistant", "a"), (101, 0, "human", "h"), (None, 0, "user", None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_records(chat.conversation_records(rows))
    counts = {r["layout"]: r["n"] for r in chat.layout_counts(formatted).collect()}
    assert None not in counts and set(chat.LISTS) | set(chat.PAIRS) | {"system_question"} <= set(counts)
    got = {(r["conv_id"], k): x for r in formatted.collect() for k, x in enumerate(chat.parse(r["formatted"]))}
    assert got == {(c, t): (r, x or "") for c, t, r, x in turns}


def test_checksums_are_no_secrets(spark):
    secret = [(k, f'text token = "{k:040x}" end') for k in range(1, 9)]
    sums = [(20 + k, f"commit {k * 7919:040x} was merged on a branch") for k in range(1, 20)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(secret + sums + [(50, None)], "doc_id long, text string")).collect()}
    assert all(got[k]["private"] and got[k]["n_id"] == 1 for k, _ in secret)
    assert not any(got[k]["private"] for k, _ in sums) and not got[50]["private"]


PROSE = "commit 3f786850e387550fdab836ed7e6dc881de23001b, iso-8859-1, covid-19-vaccine, utf-8-encoded, section12b/part3, sha1: 3f786850e387550fdab836ed7e6dc881de23001b"


def test_prose_holds_no_identifiers(spark):
    """Pieces of addresses teach nothing, and a shape that secrets have isn't enough."""
    r = random.Random(2)
    texts = [f"mail covid-19-vaccine{k}@iso-8859-{k}.example.org and utf-8-encoded.x{k}@section12b{k}.org" for k in range(30)]
    texts += [f'set token = "{r.randrange(16**40):040x}" ok' for _ in range(30)] + [PROSE]
    got = {x["doc_id"]: x["spans"] for x in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[len(texts) - 1] == ""
    assert all("id:13:53" in got[k] for k in range(30, 60)) and not any("id:" in got[k] for k in range(30))


def plain_bootstrap(texts):
    """Accepted patterns by a plain loop over the same graph."""
    graph = {}
    for t in texts:
        for m in re.finditer(r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*[0-9])[A-Za-z0-9][A-Za-z0-9_/-]{6,}(?<=[A-Za-z0-9])(?![A-Za-z0-9])", t):
            near = re.search(r"([a-z_]{2,20}[^\w]{1,5})$", t[: m.start()].lower())
            lexical = near[1] if near and re.search(r"[^\w\s]", near[1]) else None
            v = m[0]
            hexed = re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)
            shape = f"digits:{len(v)}" if v.isdigit() else f"hex:{len(v)}" if hexed else f"key:{v[:4]}:{len(v)}" if re.fullmatch("[A-Z]{3,5}[0-9A-Z]+", v) else "form:" + re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", v)))
            graph[v, lexical, shape] = bool(re.fullmatch("AKIA[0-9A-Z]{16}", v) or lexical and re.match(r"(token|secret|password|apikey)[^\w]{1,5}$", lexical))
    public = lambda x: x and re.match(r"(commit|sha|checksum)[^\w]{1,5}$", x)
    score = {k: float(s) for k, s in graph.items()}
    for _ in range(pii.ROUNDS):
        mean = [collections.defaultdict(list), collections.defaultdict(list)]
        for k in graph:
            for side in (0, 1):
                mean[side][k[side + 1]].append(score[k])
        sizes = [{p: len(x) for p, x in own.items()} for own in mean]
        mean = [{p: sum(x) / (len(x) + 1) for p, x in own.items()} for own in mean]
        score = {k: 1.0 if s else 0.0 if k[1] is None or public(k[1]) else 1 - (1 - mean[0][k[1]]) * (1 - mean[1][k[2]]) for k, s in graph.items()}
    chosen = [{p for p, s in mean[side].items() if p and s >= pii.CONFIDENCE and sizes[side][p] >= pii.INSTANCES and not (side == 0 and public(p))} for side in (0, 1)]
    return chosen


def test_bootstrap_against_a_plain_loop(spark):
    r = random.Random(9)
    hexed = lambda n: f"{r.randrange(16**n):0{n}x}"
    base62 = lambda: "".join(r.choice("abXY19") for _ in range(10)) + "7q"
    texts = [f"a {c}{hexed(40)} ok" for c in ["token=", 'secret: "', "login=(", "blob, ", "sha: ", "commit "] for _ in range(25)]
    texts += [f"x {c}{base62()} y AKIA{r.randrange(10**15, 10**16)}" for c in ("apikey -> ", "pass: [", "see (") for _ in range(9)]
    texts += [f"order no: {r.randrange(10**7, 10**8)} and {hexed(16)}" for _ in range(30)]
    learned = pii.bootstrap(spark.createDataFrame([(t,) for t in [*texts, *texts, None, ""]], "text string"))
    lexical, shape = plain_bootstrap(texts)
    assert (set(learned.lexical), set(learned.shape)) == (lexical, shape) and learned.rest is None
    assert "login=(" in lexical and not {"sha: ", "order no: ", "no: "} & lexical


def test_every_byte_needs_a_rank(spark):
    from corvane.llm import bpe

    with pytest.raises(ValueError, match="every byte"):
        bpe.Tokenizer(spark, {"a": 0}, r"\p{L}+")


def test_line_dedup_splits_long_texts_in_bounded_memory(monkeypatch):
    """A task holds the words of about a megabyte at once, whatever the texts, and their lines are those of plain splitting."""
    from corvane.llm import line_dedup

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab\x00é\x85 ") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 90))))
    odd = ["", "\n", " \n\t", "a", "a ", "b\n\na", "\x0b\x0ca\r\n", *("".join(word() + rng.choice(" \n\r\t\x0b\x0c") for _ in range(60)) for _ in range(40))]
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(line_dedup, "SPAN_BYTES", most)
        found = {}
        for texts in (pa.array(odd), pa.array(["x y", *odd], pa.large_string())[1:]):
            for span in line_dedup._spans(texts):
                row, line, lines = line_dedup._split(span)
                starts = lines.start
                for k in range(len(row)):
                    found.setdefault((int(row[k]), int(line[k])), set()).add(tuple(lines.h[starts[k] : starts[k] + lines.n[k]].tolist()))
        plain = {(i, j): x.split() for i, t in enumerate(odd) for j, x in enumerate(t.encode().split(b"\n")) if x.split()}
        assert found.keys() == plain.keys() and all(len(x) == 1 for x in found.values())
        pairs = {(w, h) for k, x in plain.items() for w, h in zip(x, next(iter(found[k])), strict=True)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})

    long = pa.array(["some eight words stand in each line here\n" * 200_000])
    tracemalloc.start()
    assert sum(len(line_dedup._split(span)[0]) for span in line_dedup._spans(long)) == 200_000
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_byte_bpe_codes_and_decodes_each_frequent_piece_once(spark):
    """Texts only join what is held of a piece: its ids as bytes, and what these decode to."""
    import public_tokenizers
    import tiktoken

    from corvane.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t.encode("latin-1"): r for t, r in ranks.items()}, special_tokens={})
    text = "zq\xe9zq \u6f22\u5b57 unheardofness" + " " + "x" * 40 + "yz" * 11
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    tokenizer = bpe.Tokenizer(spark, ranks, public_tokenizers.PATTERN)
    held = {k: v for m in tokenizer.held(docs, "text").first()["a"] for k, v in (m or {}).items()}
    assert "".join(sorted(held)) and all(k in text for k in held)
    for piece, coded in held.items():
        ids = own.encode_ordinary(piece)
        assert coded["i"].encode("latin-1") == b"".join(i.to_bytes(4, "little") for i in ids) and coded["d"].encode("latin-1") == piece.encode()
