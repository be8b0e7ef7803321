"""Benchmark decontamination with an FM-index for each shard of the documents.

A shard is a bounded run of documents inside a task. Words that stand in no window of the benchmark are alike for the
search, so a shard keeps only runs of benchmark words that are long enough to hold a window; the runs, parted by a
separator, are one sequence over the benchmark's vocabulary. The FM-index of that sequence has its Burrows-Wheeler
transform in a wavelet matrix, whose ranks drive the backward search of all windows at once; occurrences are located from
sampled suffix positions, and covered words are merged into removal spans. Documents are never shuffled.

The benchmark is searched in blocks of bounded size; one block is what a task holds of it.

Defined results: null and empty texts have no words and no hits; items without a word are ignored; an item with a null id
counts for hits but not for the list of items; ids of any type are strings in it; repeated rows give repeated results; items
that repeat an id count once; without items nothing is hit; an empty table gives an empty table; extra columns are kept, but
for ones with the names that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import ascii_words, utf8

WINDOW = 13
#: Bytes of benchmark text in a block, words in a shard, and bytes of a text that are split into words at once.
BLOCK_BYTES, SHARD_WORDS, SLICE_BYTES = 8 << 20, 2_000_000, 1 << 20
#: Every so many positions of a sequence is in the index.
SAMPLED = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k) & 1
            ones = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(end)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[start], ones[end]
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[at], ones[start]
            one = ones[at + 1] > a
            symbol = (symbol << 1) | one
            start, at = np.where(one, zeros + b, start - b), np.where(one, zeros + a, at - a)
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    while True:
        same = ~first
        tied = same | np.concatenate([same[1:], [False]])  # places in groups of two or more
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        members = order[places]
        ahead = members + width
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[members]
        again = np.lexsort((after, group))
        members, after, group = members[again], after[again], group[again]
        order[places] = members
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first[places] = new
        rank[members] = np.maximum.accumulate(np.where(new, places, 0))
        width *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 on."""

    def __init__(self, sequence: np.ndarray, sigma: int, sampled: int = SAMPLED):
        symbols = np.concatenate([sequence, [0]]).astype(np.int64)
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.wavelet = WaveletMatrix(symbols[order - 1], sigma)
        marked = order % sampled == 0
        self.marks = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` that occur, and their intervals of suffixes."""
        rows = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[rows, k]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
            found = low < high
            rows, low, high = rows[found], low[found], high[found]
            if not len(rows):
                break
        return rows, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps towards the front until a sampled one is met."""
        out, steps, open_ = np.zeros(len(at), dtype=np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(open_):
            hit = self.marks[at]
            out[open_[hit]] = self.positions[self.mark_rank[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            symbol, before = self.wavelet.access(at)
            at = self.before[symbol] + before
            steps += 1
        return out


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The distinct windows of a block of items, by length, as symbols; 1 is the separator."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int = WINDOW):
        self.ids = _Ids()
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 2) for w in ascii_words(text)]
            n = min(size, len(words))
            for i in range(len(words) - n + 1) if n else ():
                by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
        self.sigma = len(self.ids) + 2
        self.patterns = {n: np.array(list(w), dtype=np.int64) for n, w in by_length.items()}
        self.items = {n: [sorted(x for x in s if x is not None) for s in w.values()] for n, w in by_length.items()}
        self.known = {n: np.isin(np.arange(self.sigma), p) for n, p in self.patterns.items()}

    def symbols(self, text: bytes | None) -> Iterator[np.ndarray]:
        """Symbols of a text's words, 0 for words of no window, in pieces of bounded size."""
        at, end = 0, len(text or b"")
        while at < end:
            stop = at + SLICE_BYTES
            while stop < end and (text[stop] >= 128 or chr(text[stop]).isalnum()):
                stop += 1
            words = ascii_words(text[at:stop])
            yield np.fromiter(map(self.ids.__getitem__, words), dtype=np.int32, count=len(words))
            at = stop

    def hits(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Which words lie in an occurrence, and (window length, row of the window, starts) of those that occur."""
        keep = np.zeros(len(symbols), dtype=bool)
        for n, known in self.known.items():
            inside = np.concatenate([[0], known[symbols].astype(np.int8), [0]])
            edge = np.diff(inside)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = ends - starts >= n
            delta = np.zeros(len(symbols) + 1, dtype=np.int32)
            delta[starts[long]], delta[ends[long]] = 1, -1
            keep |= np.cumsum(delta[:-1]) > 0
        places = np.flatnonzero(keep)
        covered = np.zeros(len(symbols) + 1, dtype=np.int32)
        if not len(places):
            return covered[:-1] > 0, []
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        sequence = np.insert(symbols[places], gaps, 1)
        places = np.insert(places, gaps, -1)
        index = FMIndex(sequence, self.sigma)
        found = []
        for n, patterns in self.patterns.items():
            rows, low, high = index.search(patterns)
            if len(rows):
                counts = high - low
                suffixes = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                starts = places[index.locate(suffixes)]
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + n, -1)
                found += [(n, int(r), s) for r, s in zip(rows, np.split(starts, np.cumsum(counts)[:-1]))]
        return np.cumsum(covered[:-1]) > 0, found


class _Shard:
    """Documents that are gathered until their words fill a shard; texts beyond are cut with an overlap."""

    def __init__(self, windows: Windows, docs: int):
        self.windows, self.parts, self.owner, self.offset, self.size = windows, [], [], [], 0
        self.n_words = np.zeros(docs, dtype=np.int64)
        self.spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
        self.items: list[set] = [set() for _ in range(docs)]

    def add(self, doc: int, text: bytes | None) -> None:
        overlap = np.empty(0, dtype=np.int32)
        for piece in self.windows.symbols(text):
            part = np.concatenate([overlap, piece])
            self.parts += [part, np.zeros(1, dtype=np.int32)]
            self.owner += [doc]
            self.offset += [int(self.n_words[doc]) - len(overlap)]
            self.n_words[doc] += len(piece)
            self.size += len(part) + 1
            overlap = part[-(WINDOW - 1) :]
            if self.size >= SHARD_WORDS:
                self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        starts = np.cumsum([0, *(len(a) + 1 for a in self.parts[::2])])[:-1]
        covered, found = self.windows.hits(np.concatenate(self.parts))
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            at = self.offset[k] - int(starts[k])
            self.spans[self.owner[k]].append((a + at, b + at))
        for n, row, at in found:
            for k in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                self.items[self.owner[k]].update(self.windows.items[n][row])
        self.parts, self.owner, self.offset, self.size = [], [], [], 0


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


NAMES = ("n_words", "spans", "items")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(docs: DataFrame, text: str, items: list[Row], added: tuple[str, str, str]) -> DataFrame:
    """One pass over ``docs`` with one block."""
    held = [(r["id"], r["text"].encode("utf-8", "surrogatepass")) for r in items]
    keep = [f for f in docs.schema.fields if f.name not in added or f.name == text]
    names = [f.name for f in keep]
    made: list[Windows] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Windows(held))
        for batch in batches:
            shard = _Shard(made[0], batch.num_rows)
            for k, raw in enumerate(utf8(batch.column(names.index(text)))):
                shard.add(k, raw)
            shard.flush()
            spans = [[{"start": a, "end": b} for a, b in merge(s)] for s in shard.spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.n_words), pa.array(spans, _SPANS), pa.array([sorted(x) for x in shard.items], pa.list_(pa.string()))], [*names, *added])

    new = zip(added, ("long", "array<struct<start:long,end:long>>", "array<string>"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{n}` {t}" for n, t in new)])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, ddl)


def _union(a: Column, b: Column) -> Column:
    """Two lists of spans as one list of spans that don't touch."""
    longer = lambda x, s: F.struct(x["start"].alias("start"), F.greatest(x["end"], s["end"]).alias("end"))

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer(last, s)))
        return F.when(F.size(out) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(F.concat(a, b)), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", added: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word spans that benchmark windows cover, merged) and ``items`` (ids as strings),
    under the names in ``added``.

    The first block is searched in the pass that returns the documents. Further blocks return their hits only, by the
    text's hash, since equal texts have equal hits; these few rows are joined back. No text is written again.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    block = lambda k: (items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)).collect()
    out = _search(docs, text, block(0), added)
    if blocks == 1:
        return out
    hashes = lambda c: (F.xxhash64(c), F.hash(c))
    key = ["__h__", "__g__"]
    texts = docs.select(F.col(f"`{text}`").alias("t"))
    hits = None
    for k in range(1, blocks):
        one = _search(texts, "t", block(k), NAMES).where(F.size("spans") > 0).select(*[h.alias(n) for h, n in zip(hashes("t"), key)], "spans", "items")
        one = one.groupBy(*key).agg(F.first("spans").alias("s"), F.first("items").alias("i"))  # copies of a text
        hits = one if hits is None else hits.unionByName(one)
    flat = F.flatten(F.collect_list("s")), F.array_distinct(F.flatten(F.collect_list("i")))
    hits = hits.groupBy(*key).agg(flat[0].alias("__s__"), flat[1].alias("__i__"))  # at most a list of each block
    joined = out.withColumns(dict(zip(key, hashes(f"`{text}`")))).join(hits, key, "left")
    with_more = {
        added[1]: F.when(F.col("__s__").isNull(), F.col(added[1])).otherwise(_union(F.col(added[1]), F.col("__s__"))),
        added[2]: F.when(F.col("__i__").isNull(), F.col(added[2])).otherwise(F.array_sort(F.array_union(added[2], "__i__"))),
    }
    return joined.withColumns(with_more).drop(*key, "__s__", "__i__")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs.select("doc_id", "text"), benchmark).drop("text").withColumn("n_hit", n_hit())
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
