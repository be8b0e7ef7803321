"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (1 to 3 characters of words padded with ``_``) in order of frequency,
counted over every training document. A document is given the language whose profile is nearest by the out-of-place
distance: for each of the document's most frequent n-grams the difference of ranks, or the profile's length if absent.
N-grams are counted as whole numbers in arrays; their order is that of their texts.

Defined results: null text and text without a letter give ``und`` with score 0; with no training rows every document is
``und``; ties go to the first language in alphabetical order; repeated rows give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

#: N-grams in a profile.
PROFILE = 400
#: Profiles reach the driver and every task: so many languages are allowed at most (ISO 639-3 names about 8,000).
MAX_LANGUAGES = 10_000
#: Characters that are counted at once, so that the memory a text takes is bounded.
CHUNK = 1_000_000
_OTHER = re.compile(r"[\W\d_]+")
#: An n-gram is its characters' code points plus one, 21 bits each from the left; 0 where it has ended. ``_`` is a word's edge.
_BITS, _EDGE = 21, ord("_") + 1


def words(text: str) -> str:
    """Lower-cased words with one ``_`` between them, without the outer ones."""
    return _OTHER.sub("_", text.lower()).strip("_")


def _code(gram: str) -> int:
    return sum((ord(c) + 1) << _BITS * (2 - i) for i, c in enumerate(gram))


def _gram(code: int) -> str:
    return "".join(chr(c - 1) for c in (code >> _BITS * 2, code >> _BITS & (1 << _BITS) - 1, code & (1 << _BITS) - 1) if c)


def _tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each stands."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    new = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return codes[first], np.diff(first, append=len(codes)) if counts is None else np.add.reduceat(counts, first)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of ``words`` in order, and how often each stands."""
    chars = np.frombuffer(f"_{text}_".encode("utf-32-le"), dtype="<u4") if text else np.zeros(0, dtype="<u4")
    parts = []
    for at in range(0, len(chars), CHUNK):
        c = chars[at : at + CHUNK + 2].astype(np.int64) + 1
        inner = c != _EDGE
        two = c[:-1] << _BITS * 2 | c[1:] << _BITS
        three = (two[:-1] | c[2:])[inner[1:-1]]
        parts.append(_tally(np.concatenate([(c[:CHUNK] << _BITS * 2)[inner[:CHUNK]], two[:CHUNK], three])))
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate([np.zeros(0, dtype=np.int64), *p]) for p in (zip(*parts) if parts else ((), ())))
    return _tally(codes, counts) if len(codes) else (codes, counts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, dict[str, int]]:
    """Profiles as language -> n-gram -> rank. Counts are summed in the tasks first, so that a language with most of the
    rows sends one count per n-gram and batch."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: dict[str, list[str]] = {}
        for tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(tag, []).append(words(body))
        found = [(tag, *count_grams("_".join(filter(None, own)))) for tag, own in texts.items()]
        tags = pa.array([tag for tag, codes, _ in found for _ in range(len(codes))], pa.string())
        return pa.RecordBatch.from_arrays([tags, *[pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (1, 2)]], ["lang", "gram", "n"])

    training = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang), F.col(text))
    counts = map_batches(training, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    rows = top.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, dict[str, int]] = {}
    for r in rows:
        profiles.setdefault(r["lang"], {})[_gram(r["gram"])] = r["rank"] - 1
    return dict(sorted(profiles.items()))


class Profiles:
    """All profiles as one table: a row of ranks for each n-gram that any language has."""

    def __init__(self, profiles: dict[str, dict[str, int]], size: int):
        self.langs, self.size = list(profiles), size
        row = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
        self.codes = np.array([*map(_code, row)], dtype=np.int64)
        self.ranks = np.full((len(row) + 1, len(profiles)), -1, dtype=np.int32)  # the last row: in no profile
        for k, p in enumerate(profiles.values()):
            self.ranks[[row[g] for g in p], k] = list(p.values())

    def nearest(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = self.ranks[np.where(self.codes[at] == own, at, -1)]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], max(0.0, 1.0 - float(away[best]) / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score`` added. No shuffle."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    names = [f.name for f in keep]
    table = Profiles(profiles, size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        for body in batch.column(len(names)).to_pylist():
            own = words(body) if body else ""
            lettered = any(map(str.isalpha, own))  # words also hold number signs such as ½
            lang, score = table.nearest(*count_grams(own)) if lettered else ("und", 0.0)
            langs.append(lang)
            scores.append(score)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in names], F.col(text)), run, ddl)


def report(docs: DataFrame) -> DataFrame:
    """One row per document; rows whose crc32(doc_id) mod 4 is 2 are held out. A null doc_id is not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = train(docs.where(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), profiles)
