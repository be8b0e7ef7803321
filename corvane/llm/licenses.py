"""Licence scan by a positional index of rare tokens.

Licence templates (a fixed, short library) are indexed by word and position. Document frequencies of the template
vocabulary are counted over the whole corpus, which gives each licence word its IDF. In a file, each template is anchored
at the word of highest IDF in its mandatory key phrases, which every placement holds: every place of that word fixes a
relative position, at which the template's other postings are intersected with the file's words. A placement counts if the template's mandatory
key phrases stand at their places and enough of its words agree.

Defined results: null or empty text has no words and no labels; repeated rows give repeated results; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, map_batches, utf8


@dataclass(frozen=True)
class Template:
    """``words`` in order; ``keys``: (start, length) of phrases that must be present; ``share``: of words that must agree."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, int], ...]
    share: float = 0.8
    base: bool = False


def template(label: str, text: str, *keys: str, share: float = 0.8, base: bool = False) -> Template:
    words = tuple(ascii_words(text.encode()))
    spans = []
    for key in keys or (text,):
        part = tuple(ascii_words(key.encode()))
        start = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        spans.append((start, len(part)))
    return Template(label, words, tuple(spans), share, base)


# The phrases that give the base labels.
BASE = (
    template("gpl", "gnu general public license", base=True),
    template("apache", "apache license", base=True),
    template("cc-by", "cc by", base=True),
    template("mit", "mit license", base=True),
)
# Wording of public licence notices.
NOTICES = (
    template("apache-2.0", "licensed under the apache license version 2.0", "apache license version 2.0"),
    template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software", "general public license"),
    template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", "free of charge"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    template("mpl-2.0", "mozilla public license version 2.0", "mozilla public license"),
    template("cc-by-nc", "cc by nc"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("cc0", "cc0 1.0 universal", "cc0"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "any purpose with or without fee"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
TEMPLATES = BASE + NOTICES

SCHEMA = "n_words long, places array<struct<label:string,start:long,words:int,share:double,base:boolean>>"


def document_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and the number of documents. The result has at most one
    row for each template word, whatever the corpus."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[bytes, int] = {b"": batch.num_rows}
        for raw in utf8(batch.column(0)):
            for w in vocabulary.intersection(ascii_words(raw)):
                found[w] = found.get(w, 0) + 1
        return pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    rows = map_batches(docs.select(F.col(text)), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def find(words: list[bytes], templates: tuple[Template, ...], idf: dict[bytes, float]) -> list[tuple[str, int, int, float, bool]]:
    """All verified placements in one file: (label, first word, words, share of agreeing words, base)."""
    present = set().union(*(t.words for t in templates)).intersection(words)
    if not present:
        return []
    usable, anchors = [], set()
    for t in templates:
        if all(w in present for s, n in t.keys for w in t.words[s : s + n]):
            word, i = max(((t.words[i], i) for s, n in t.keys for i in range(s, s + n)), key=lambda x: (idf.get(x[0], 0.0), x))
            usable.append((t, word, i))
            anchors.add(word)
    postings: dict[bytes, list[int]] = {a: [] for a in anchors}
    for i, w in enumerate(words) if anchors else ():
        if w in postings:
            postings[w].append(i)
    found = []
    for t, anchor, i in usable:
        for at in [p - i for p in postings[anchor]]:
            if any(at + s < 0 or tuple(words[at + s : at + s + n]) != t.words[s : s + n] for s, n in t.keys):
                continue
            lo = max(at, 0)
            share = sum(a == b for a, b in zip(words[lo : at + len(t.words)], t.words[lo - at :])) / len(t.words)
            if share >= t.share:
                found.append((t.label, lo, len(t.words), share, t.base))
    return found


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and ``places`` (every verified template placement) added.

    Two passes over the text column, no shuffle of documents; what reaches the driver and the tasks is bounded by the
    template library.
    """
    df, n = document_frequencies(docs, text, templates)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for t in templates for w in t.words}
    keep = [f for f in docs.schema.fields if f.name not in (text, "n_words", "places")]
    names = [f.name for f in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, places = [], []
        for raw in utf8(batch.column(len(names))):
            words = ascii_words(raw)
            counts.append(len(words))
            places.append([dict(zip(("label", "start", "words", "share", "base"), x)) for x in find(words, templates, idf)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(places, kind)], [*names, "n_words", "places"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), SCHEMA])
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names], F.col(text)), run, ddl)


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the digest columns of the contract."""
    places = scan(docs.select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return places.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
