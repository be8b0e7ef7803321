"""Periodic runs of words: a harmonic grid of probes for each period, survivors extended by chunked comparison.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``MIN_WORDS`` words
and ``MIN_REPEATS`` periods that no neighbouring word extends. Such a stretch covers ``MIN_REPEATS`` grid points jq one after
the other, so only places where words jq, (j+1)q, (j+2)q, ... are equal need a closer look. All periods together probe
n/1 + n/2 + n/3 + ... words, n log n in all, and texts of one chunk are probed together.

Each text is judged alone, in the task that reads it: nothing is shuffled. A task holds one Arrow batch and the numbers of
at most ``CHUNK_WORDS`` words, or of one longer text.

Defined results: a null text and a text of white space have no words, no runs and an empty collapsed text; rows of
equal texts are judged alike; an empty table gives no rows; extra columns, whatever their names, are left as they are, but for one named as the added column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import let

MIN_WORDS, MIN_REPEATS = 6, 4
CHUNK_WORDS = 1 << 20
#: Equalities beside a survivor that are tested for all survivors at once, before one is extended.
NEAR = 8
_STEP = 256
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Words are separated by the bytes 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"


def _first(differs: np.ndarray) -> int:
    """Place of the first True, or the length."""
    at = int(differs.argmax()) if len(differs) else 0
    return at if len(differs) and differs[at] else len(differs)


def _extended(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch [low, high) around ``at`` in which each word equals the one p later; chunks double as long as they fit."""
    high, step, last = at + 1, _STEP, len(ids) - p
    while high < last:
        n = min(step, last - high)
        same = _first(ids[high : high + n] != ids[high + p : high + p + n])
        high += same
        if same < n:
            break
        step *= 2
    low, step = at, _STEP
    while low > 0:
        n = min(step, low)
        same = _first((ids[low - n : low] != ids[low - n + p : low + p])[::-1])
        low -= same
        if same < n:
            break
        step *= 2
    return low, high


def stretches(ids: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """start, length, period of all runs in ``ids``: texts one after the other, longest first, each followed by a number
    of its own. ``lengths`` counts words with that number."""
    ends = np.cumsum(lengths)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    seen: set[tuple[int, int]] = set()
    out: list[tuple[int, int, int]] = []
    longest = int(lengths[0]) - 1 if len(lengths) else 0
    for p in range(1, longest // repeats + 1):
        fit = int(np.searchsorted(-lengths, -(max(min_words, repeats * p) + 1), side="right"))
        if not fit:
            break
        grid = ids[: ends[fit - 1] : p]
        same = grid[:-1] == grid[1:]
        hit = same[repeats - 2 :].copy()
        for k in range(repeats - 2):
            hit &= same[k : len(same) - repeats + 2 + k]
        at = np.flatnonzero(hit) * p
        for k in range(1, min(NEAR, (repeats - 2) * p) + 1):
            if not len(at):
                break
            at = at[ids[at + k] == ids[at + k + p]]
        for q, (starts, stops) in known.items():
            if not len(at):
                break
            if p % q == 0:  # inside a run of a divisor the stretch of p is that run
                own = np.searchsorted(starts, at, side="right") - 1
                at = at[(own < 0) | (at + (repeats - 1) * p >= stops[own])]
        found, covered = [], 0
        for s in at.tolist():
            if s < covered:
                continue
            low, covered = _extended(ids, s, p)
            if covered + p - low >= max(min_words, repeats * p) and (low, covered + p) not in seen:
                found.append((low, covered + p))
        if found:
            seen.update(found)
            known[p] = tuple(np.array(x) for x in zip(*found))
            out += [(low, high - low, p) for low, high in found]
    return out


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``CHUNK_WORDS`` words, or one text."""
    begin = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and total + n > CHUNK_WORDS:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _runs(texts: pa.Array) -> pa.StructArray:
    """``FOUND`` of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words, parents = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0)
    words, parents = words.filter(real), parents[real.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    kept = np.ones(len(words), dtype=bool)
    held: list[tuple[int, int, int, int]] = []
    for begin, end in _chunks(sizes):
        own = np.argsort(-sizes[begin:end], kind="stable") + begin
        numbers = words[firsts[begin] : firsts[end]].dictionary_encode().indices.to_numpy().astype(np.int64)
        lengths = sizes[own] + 1
        ids = np.empty(int(lengths.sum()), dtype=np.int64)
        place, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(lengths)
        for k, doc in enumerate(own.tolist()):
            ids[place[k] : ends[k] - 1] = numbers[firsts[doc] - firsts[begin] : firsts[doc + 1] - firsts[begin]]
        ids[ends - 1] = -1 - np.arange(len(own))
        for start, length, period in stretches(ids, lengths):
            k = int(np.searchsorted(ends, start, side="right"))
            doc, local = int(own[k]), start - int(place[k])
            held.append((doc, local, length, period))
            kept[firsts[doc] + local + period : firsts[doc] + local + length] = False
    held.sort()
    docs, *columns = (np.array(x, dtype=np.int64) for x in (zip(*held) if held else [[]] * 4))
    per = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(texts)))])
    runs = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"]))
    after = np.concatenate([[0], np.cumsum(np.bincount(parents[kept], minlength=len(texts)))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(after, pa.int32()), words.filter(pa.array(kept))), " ")
    return pa.StructArray.from_arrays([pa.array(sizes), runs, collapsed], ["n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text", added: str = "__runs__") -> DataFrame:
    """``docs`` with a struct ``added``: ``n_words``, ``runs`` (start, length and period, by start, then period) and
    ``collapsed``, the words outside runs and those of each run's first period, joined by one space."""

    rows = docs.drop(added)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _runs(batch.column(at))], [*batch.schema.names, added])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(added, StructType.fromDDL(FOUND))]))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: where the id's checksum ends in 0, all words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words, repeated)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: the number of runs, the longest one, digests of all runs and of the collapsed text."""
    rows = with_runs(docs.select(F.col("doc_id"), planted(F.col("doc_id"), F.col("text")).alias("text")))
    runs = F.col("__runs__.runs")
    best = F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, x: F.when(a.isNull() | (x["length"] > a["length"]), x).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = rows.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("__runs__.collapsed"), 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
