"""Line deduplication by a deletion-neighbourhood join over words.

A line is the words between white space. Two lines are near if one word substituted, inserted or deleted turns one into
the other and the longer has at least ``min_words`` words (``MIN_WORDS`` by default, 1 for all lines); shorter lines are compared for
equality only. A line goes if an
earlier line (by doc_id, then place in the text) is equal or near to it; the earliest of a neighbourhood stays.

1.  Every line is reduced to 64-bit hashes: of all its words and of its halves. Equal lines become one, the earliest.
2.  Two near lines agree in their first or in their last half, so only lines that share a half with another go on; an
    edit can only be outside the half that is shared.
3.  These emit their variants within one deletion as hashed keys. A substitution makes equal variants at the same place; an
    insertion makes the shorter line a variant of the longer. Variants meet under their key, where each line's earliest
    partner is a minimum over the key: no pairs are formed, however many lines share a key. Minima are combined in the tasks
    before the shuffle, and rows come back to them by joins that deal out hot keys.
4.  The lines that lose are verified against their partner word by word.

Defined results: null texts have no lines; lines without a word are never removed and never count; rows that repeat doc_id
and text are one document, of which the repeated lines fall together; null doc_ids come last; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.curate import numbered
from ..session import kept, scratch, stored
from .common import spread_join

MIN_WORDS = 8
#: Up to so many bytes (64 a document with candidate lines and 48 a line) their list is sent to all tasks; beyond, documents are
#: shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of texts that a task splits at once. Words and their hashes take some 25 times as much.
SPAN_BYTES = 1 << 20
#: Distinct lines that a task remembers, at 8 bytes each.
SEEN = 500_000
#: White space as ``bytes.split`` has it, by byte.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_NEWLINE = 10
#: Words with more bytes are hashed one by one.
LONG_WORD = 64
#: Masks of a word's lowest bytes, by their number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_P = 0x9E3779B97F4A7C15  # odd: word hashes are weighted by powers of it, so that parts of a line can be moved
_INVERSE = pow(_P, -1, 2**64)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.values = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) <= n:
            self.values = np.full(max(2 * len(self.values), n + 1), self.base, dtype=np.uint64)
            self.values[0] = 1
            np.multiply.accumulate(self.values, out=self.values)
        return self.values


_UP, _DOWN = _Powers(_P), _Powers(_INVERSE)


class Lines:
    """Hashes of many lines at once, given their numbers of words and the words' hashes. A line's hash is the sum of its word
    hashes times powers of their places, plus its number of words; sums of any part come from one running sum."""

    def __init__(self, n: np.ndarray, h: np.ndarray):
        self.n, self.h = n, h
        self.start = np.cumsum(self.n) - self.n
        self.place = np.arange(len(h)) - np.repeat(self.start, self.n)
        longest = int(self.n.max(initial=0)) + 1
        self.up, self.down = _UP.upto(longest), _DOWN.upto(longest)
        self.terms = self.h * self.up[self.place]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.terms)])

    def whole(self) -> np.ndarray:
        return self.sums[self.start + self.n] - self.sums[self.start] + self.n.astype(np.uint64)

    def halves(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n // 2 and of the last n - n // 2 words, marked by n and side."""
        k, end = n // 2, self.start + self.n
        m = n - k
        first = self.sums[self.start + k] - self.sums[self.start]
        last = (self.sums[end] - self.sums[end - m]) * self.down[self.n - m]
        mark = lambda side: (2 * n + side + 1).astype(np.uint64) * np.uint64(_P)
        return first ^ mark(0), last ^ mark(1)

    def variants(self, first: np.ndarray, last: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, roles and line indexes of the deletion neighbourhoods of lines that share their first or last half.
        Roles: 0 a place left out (substitution), 1 the line itself, 2 one word less."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        n, all_ = self.n[line], self.whole()
        open_ = (n >= min_words) & ((first[line] & (self.place >= (n - 1) // 2)) | (last[line] & (self.place <= (n + 1) // 2)))
        at = np.flatnonzero(open_)
        line, n, place = line[at], n[at], self.place[at]
        substituted = all_[line] - self.terms[at] + (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(_INVERSE)
        end = self.start[line] + n
        before, after = self.sums[at] - self.sums[self.start[line]], (self.sums[end] - self.sums[at + 1]) * self.down[1]
        shorter = before + after + (n - 1).astype(np.uint64)
        own = np.arange(len(self.n))
        roles = np.repeat(np.array([0, 2, 1], dtype=np.int8), (len(at), len(at), len(own)))
        return np.concatenate([substituted, shorter, all_]), roles, np.concatenate([line, line, own])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


class _Spans(NamedTuple):
    """Adjacent bytes of texts, cut where a text or, in a long one, a line begins: for each part its row, the number of its
    first line, and where it begins."""

    data: np.ndarray
    row: np.ndarray
    line: np.ndarray
    begin: np.ndarray


def _spans(texts: pa.Array) -> Iterator[_Spans]:
    """The bytes of a string column, about ``SPAN_BYTES`` at a time; more only where one line has more."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    held: list[tuple[int, int, int]] = []

    def out(end: int) -> _Spans:
        row, line, begin = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
        held.clear()
        return _Spans(data[begin[0] : end], row, line, begin - begin[0])

    for row, (at, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        held.append((row, 0, at))
        if end - at > SPAN_BYTES:
            below = at + 1 + np.flatnonzero(data[at:end] == _NEWLINE)  # where lines begin
            while end - held[0][2] > SPAN_BYTES and (k := int(np.searchsorted(below, held[0][2] + SPAN_BYTES))) < len(below):
                yield out(int(below[k]))
                held.append((row, k + 1, int(below[k])))
        if end - held[0][2] >= SPAN_BYTES:
            yield out(end)
    if held:
        yield out(int(ends[-1]))


def _mixed(z: np.ndarray) -> np.ndarray:
    """One to one, each bit of the result from all bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: their lengths and eight bytes after eight mixed in, for all words at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = (end - begin).astype(np.uint64) * np.uint64(_P)
    at, where = np.arange(len(begin)), begin
    while len(at) and where[0] - begin[at[0]] < LONG_WORD:
        left = end[at] - where
        h[at] = _mixed(h[at] ^ (eight[where] & _LOWEST[np.minimum(left, 8)]))
        at, where = at[left > 8], where[left > 8] + 8
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]])
    return h


def _words(span: _Spans) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end."""
    word = ~_BLANK[span.data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = span.begin[span.begin < len(word)]
    first[edge] = word[edge]
    last[edge[edge > 0] - 1] = word[edge[edge > 0] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _split(span: _Spans) -> tuple[np.ndarray, np.ndarray, Lines]:
    """The lines with a word: their rows, their numbers in the text, their hashes."""
    begin, end = _words(span)
    above = np.cumsum(span.data == _NEWLINE, dtype=np.int64)
    part = np.searchsorted(span.begin, begin, side="right") - 1
    before = np.concatenate([[0], above])[span.begin]
    row, line = span.row[part], span.line[part] + above[begin] - before[part]
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    return row[at], line[at], Lines(np.diff(np.append(at, len(begin))), _hashes(span.data, begin, end))


def _lines(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per line with a word: doc_id, text_hash, line, whole, and at a line's first place that a task sees its halves
    (again at a later one, if too many distinct lines came before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, dtype=np.uint64)
        for batch in batches:
            for span in _spans(batch.column(2)):
                row, line, lines = _split(span)
                if not len(row):
                    continue
                whole = lines.whole()
                values, at = np.unique(whole, return_index=True)
                fresh = ~_among(values, seen)
                new = np.zeros(len(whole), dtype=bool)
                new[at[fresh]] = True
                # Both runs are sorted, which a stable sort makes use of.
                seen = np.sort(np.concatenate([seen if len(seen) < SEEN else seen[:0], values[fresh]]), kind="stable")
                yield out(batch, row, line, lines, whole, new)

    def out(batch: pa.RecordBatch, row: np.ndarray, line: np.ndarray, lines: Lines, whole: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        own, less = new & (lines.n >= min_words - 1), new & (lines.n >= min_words)
        n = np.maximum(lines.n, 2)
        columns = [*lines.halves(lines.n), *lines.halves(n - 1)]
        taken = np.stack([own, own, less, less], axis=1)
        ends = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
        halves = np.stack(columns, axis=1)[taken]
        index = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(index), batch.column(1).take(index), pa.array(line), _signed(whole), pa.ListArray.from_arrays(pa.array(ends), _signed(halves))],
            ["doc_id", "text_hash", "line", "whole", "halves"],
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, line long, whole long, halves array<long>")


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(those):
        return np.zeros(len(values), dtype=bool)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")


def _texts(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """whole, first, last, o, text of the chosen lines, fetched at the place of their first occurrence."""
    wanted = chosen.groupBy("at.doc_id", "at.text_hash").agg(F.collect_list(F.struct("at.line", "whole", "first", "last", "o")).alias("lines"))
    wanted = stored(wanted, "lines-wanted")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), text_hash(text).alias("h"), F.col(text).alias("text"))
    same = (rows["h"] == wanted["text_hash"]) & rows["d"].eqNullSafe(wanted["doc_id"])
    size = wanted.agg(F.sum(F.size("lines") * 48 + 64)).first()[0] or 0
    picked = rows.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, same).select(F.split("text", "\n").alias("all"), "lines")
    # Rows that repeat id and text give their lines twice.
    line = picked.select(F.explode(F.transform("lines", lambda x: x.withField("text", F.get("all", x["line"].cast("int"))))).alias("x"))
    return line.select("x.whole", "x.first", "x.last", "x.o", "x.text").dropDuplicates(["o"])


def _variants(lines: DataFrame, min_words: int) -> DataFrame:
    """key, role and order of the deletion neighbourhood of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
            for span in _spans(batch.column(3)):  # so many lines that their variants stay few
                row, _, words = _split(span)
                keys, roles, index = words.variants(flags[0][row], flags[1][row], min_words)
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(roles), batch.column(0).take(pa.array(row[index]))], ["key", "role", "o"])

    return lines.select("o", "first", "last", "text").mapInArrow(run, "key long, role byte, o long")


def _near(a: Column, b: Column) -> Column:
    """Whether word lists a and b differ by at most one substitution, insertion or deletion."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.size(F.filter(F.zip_with(short, long, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: ~x))
    front = F.coalesce(F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x == y), F.lit(False)) - 1, F.lit(-1))
    front = F.when(front < 0, F.size(short)).otherwise(front).cast("int")
    inserted = F.concat(F.slice(long, F.lit(1), front), F.slice(long, front + 2, F.greatest(F.size(long) - front - 1, F.lit(0))))
    return F.when(F.size(a) == F.size(b), same <= 1).when(F.size(long) - F.size(short) == 1, inserted == short).otherwise(F.lit(False))


def _total(counted: DataFrame) -> int:
    return counted.agg(F.sum("n")).first()[0] or 0


def _losers(rows: DataFrame, first: DataFrame, docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """whole of each distinct line to which an earlier distinct line is near."""
    halves = rows.where(F.size("halves") > 0).select("whole", F.posexplode("halves").alias("side", "half"))
    ends = halves.groupBy("half").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = stored(ends.where("a <> b").select("half", "n"), "lines-halves")
    sides = spread_join(halves, shared, "half", "n", _total(shared)).groupBy("whole").agg(F.max(F.col("side") % 2 == 0).alias("first"), F.max(F.col("side") % 2 == 1).alias("last"))
    chosen = numbered(stored(first.select("whole", "at").join(sides, "whole"), "lines-chosen"), ["at", "whole"], out="o")
    lines = stored(_texts(docs, chosen, doc_id, text), "lines-candidates")
    variants = stored(_variants(lines, min_words), "lines-variants")
    least = lambda r: F.min(F.when(F.col("role") == r, F.col("o"))).alias(f"r{r}")
    keys = variants.groupBy("key").agg(least(0), least(1), least(2), F.max(F.when(F.col("role") == 0, F.col("o"))).alias("last0"), F.count(F.lit(1)).alias("n"))
    keys = stored(keys.where("r0 < last0 or (r1 is not null and r2 is not null)").drop("last0"), "lines-keys")
    partner = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    met = spread_join(variants, keys, "key", "n", _total(keys)).withColumn("p", partner).where("p < o")
    pairs = stored(met.groupBy("o").agg(F.min("p").alias("p")), "lines-pairs")
    words = lambda c: F.filter(F.split(c, "[ \t\n\x0b\x0c\r]+"), lambda x: x != "")
    mine = pairs.join(lines.select("o", "whole", F.col("text").alias("a")), "o")
    counted = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    partners = stored(counted.join(lines.select(F.col("o").alias("p"), F.col("text").alias("b")), "p"), "lines-partners")
    both = spread_join(mine, partners, "p", "n", _total(partners))
    return both.where(_near(words("a"), words("b"))).select("whole", F.lit(True).alias("near")).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, n_lines (lines with a word), removed (places of lines that go, from 0), n_near."""
    with scratch(docs.sparkSession):
        rows = stored(_lines(docs, doc_id, text, min_words), "lines")
        first = stored(rows.groupBy("whole").agg(F.min(_place()).alias("at"), F.count(F.lit(1)).alias("n")), "lines-distinct")
        near = _losers(rows, first, docs, doc_id, text, min_words)
        fate = first.select("whole", F.col("at").alias("first_at"), "n").join(near, "whole", "left")
        # Lines that stand once and are near to none stay.
        fate = stored(fate.where("n > 1 or near"), "lines-fate")
        judged = spread_join(rows.select("doc_id", "text_hash", "line", "whole"), fate, "whole", "n", _total(first))
        gone = judged.where(F.coalesce("near", F.lit(False)) | (_place() != F.col("first_at")))
        # Places are gathered by document; a document's own lines bound the list.
        by_doc = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("n_near"))
        sizes = rows.groupBy("doc_id", "text_hash").agg(F.count_distinct("line").alias("n_lines"))
        there = [sizes["text_hash"] == by_doc["text_hash"], sizes["doc_id"].eqNullSafe(by_doc["doc_id"])]
        whole = sizes.join(by_doc, there, "left").select(sizes["doc_id"], sizes["text_hash"], "n_lines", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
        return kept(whole, "lines-removed")


def report(docs: DataFrame) -> DataFrame:
    """Per document with a line: doc_id, n_lines, n_removed, n_near, removed (comma-joined places)."""
    found = removed_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_near", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that go taken out of the text; ``n_chars`` follows where it is there. Documents that lose
    their last word this way go, those without a word before stay."""
    gone = removed_lines(docs, doc_id, text, min_words).where(F.size("removed") > 0).select(F.col("doc_id").alias("__id__"), F.col("text_hash").alias("__hash__"), F.col("removed").alias("__removed__"))
    same = (text_hash(text) == F.col("__hash__")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__id__"))
    joined = docs.join(gone, same, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__removed__"), i.cast("long"))), "\n")
    out = joined.withColumn(text, F.when(F.col("__removed__").isNotNull(), kept).otherwise(F.col(text)))
    out = out.where(F.col("__removed__").isNull() | F.col(text).rlike("[^ \t\n\x0b\x0c\r]")).drop("__id__", "__hash__", "__removed__")
    return out.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in docs.columns else out
