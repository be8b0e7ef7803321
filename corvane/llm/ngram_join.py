"""Similarity join on word n-grams: Jaccard of at least a threshold, by Bayesian pruning of MinHash candidates.

1.  Every text becomes its set of hashed n-grams, a digest of that set and a MinHash signature. Texts with equal sets are
    one class of copies; only classes go on, so copies are never expanded into pairs.
2.  Bands of signatures put classes into buckets. A bucket is dealt into blocks of bounded size; a task gets two blocks and
    compares their classes in memory. A pair belongs to the first band in which it agrees, so it is judged once.
3.  Signatures are compared a few values at a time. A pair is dropped once the posterior probability of reaching the
    threshold falls below a tolerance; the others are verified on the whole sets.
4.  Tasks return a row for each class that they link (number of links, least class that they lead to), not one for each pair.
    Least labels are spread along these links until nothing changes, which gives the groups.

Defined results: a text of fewer than n words is one n-gram of all its words; null texts and texts without a word have no
links and stand alone; repeated rows are copies of each other; ties of ids are resolved by the text's hash; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, scratch, stored
from .common import ascii_words, utf8

NGRAM, THRESHOLD = 5, 0.8
#: Bands and values in a band: a pair at the threshold shares no band with probability (1 - 0.8**5)**27 = 2e-5.
BANDS, ROWS = 27, 5
#: Signature values compared before the posterior is asked again; pairs whose probability is below the tolerance go.
STEP, TOLERANCE = 16, 1e-6
#: Classes in a block: a task holds two blocks at a time.
BLOCK = 512
#: Up to so many classes with candidates (48 bytes each) their list is sent to all tasks; beyond, documents are shuffled.
BROADCAST_ROWS = 500_000

_K = BANDS * ROWS
_SEED = np.random.Generator(np.random.PCG64(20_240_607))
_MUL = _SEED.integers(1, 2**63, _K, dtype=np.uint64) | np.uint64(1)
_ADD = _SEED.integers(0, 2**63, _K, dtype=np.uint64)


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def ngram_set(text: bytes | None, hashes: dict, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """16-bit MinHash values; long sets are taken in slices, so that memory stays bounded."""
    least = np.full(_K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096, None] * _MUL[None, :] + _ADD[None, :]
        least = np.minimum(least, part.min(axis=0))
    return ((least >> np.uint64(48)) ^ (least & np.uint64(0xFFFF))).astype(np.uint16)


@lru_cache(None)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches with which a pair stays: P(J >= threshold | matches) under a
    uniform prior on J is at least the tolerance."""
    grid = (np.arange(2000) + 0.5) / 2000
    above = grid >= threshold
    out = [0]
    for n in range(1, _K + 1):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logs - logs.max())
            if p[above].sum() >= tolerance * p.sum():
                out.append(m)
                break
        else:
            out.append(n)
    return tuple(out)


def _prune(a: np.ndarray, b: np.ndarray, upper: bool, band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of signatures that stay; ``upper``: the blocks are one, each pair once."""
    fewest = least_matches(threshold, tolerance)
    if upper:
        i, j = np.triu_indices(len(a), 1)
    else:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    matches = np.zeros(len(i), dtype=np.int32)
    for at in range(0, _K, STEP):
        end = min(at + STEP, _K)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            matches[s] += (a[i[s], at:end] == b[j[s], at:end]).sum(axis=1)
        stay = matches >= fewest[end]
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            return i, j
    if band:  # the pair belongs to the first band in which it agrees
        x, y = a[:, : band * ROWS].reshape(len(a), band, ROWS), b[:, : band * ROWS].reshape(len(b), band, ROWS)
        own = np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), 1 << 14):
            s = slice(lo, lo + (1 << 14))
            own[s] = ~(x[i[s]] == y[j[s]]).all(axis=2).any(axis=1)
        i, j = i[own], j[own]
    return i, j


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _root(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: id, hash of the text, digest of the n-gram set (null without words), size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            digests, sizes, signatures = [], [], []
            for raw in utf8(batch.column(2)):
                grams = ngram_set(raw, hashes)
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sizes.append(len(grams))
                signatures.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "digest", "n_grams", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, text_hash long, digest binary, n_grams long, signature binary")


def _order(doc_id: str = "doc_id"):
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col("text_hash"))


def _sets(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """digest, n-gram set (binary) and copies of the chosen classes, from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [ngram_set(raw, hashes).tobytes() for raw in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["digest", "copies", "grams"])

    rows = docs.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rep = chosen.select("digest", "copies", F.col("first.text_hash").alias("text_hash"), F.col("first.doc_id").alias("rep_id"))
    rep = stored(rep, "ngram-active")
    same = (rows["text_hash"] == rep["text_hash"]) & rows["doc_id"].eqNullSafe(rep["rep_id"])
    picked = rows.join(F.broadcast(rep) if rep.count() <= BROADCAST_ROWS else rep, same).select("digest", "copies", "text")
    return picked.mapInArrow(run, "digest binary, copies long, grams binary")


def _candidates(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(task, digests of block a, digests of block b, pairs as indexes) of what the pruning leaves."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.cast("byte").alias("band"), F.xxhash64(F.substring(F.col("signature"), k * (2 * ROWS) + 1, F.lit(2 * ROWS)), k).alias("key")))
    keyed = classes.select("digest", F.explode(bands).alias("b")).select("digest", "b.band", "b.key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = shared.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    # Only classes that share a bucket carry their signature on.
    members = keyed.join(shared, "key").join(classes.select("digest", "signature"), "digest")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    # A class goes to the tasks of its own block with each block: blocks i <= j.
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = members.withColumn("own", own).withColumn("t", F.explode(tasks)).select("band", "key", "t.i", "t.j", "own", "digest", "signature")
    grouped = dealt.groupBy("band", "key", "i", "j").agg(F.collect_list(F.struct("own", "digest", "signature")).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for band, i, j, members in zip(*(batch.column(c).to_pylist() for c in range(4))):
                blocks = [[m for m in members if m["own"] == k] for k in ((i,) if i == j else (i, j))]
                sigs = [np.frombuffer(b"".join(m["signature"] for m in x), dtype=np.uint16).reshape(-1, _K) for x in blocks]
                a, b = _prune(sigs[0], sigs[-1], i == j, band, threshold, tolerance)
                if len(a):
                    names = [m["digest"] for x in blocks for m in x]
                    b = b if i == j else b + len(blocks[0])
                    used, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                    pairs = flat.reshape(2, -1).astype(np.int32)
                    out.append(([names[k] for k in used], pairs[0].tobytes(), pairs[1].tobytes()))
            kinds = (pa.list_(pa.binary()), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["digests", "a", "b"])

    return grouped.select("band", "i", "j", "members").mapInArrow(run, "digests array<binary>, a binary, b binary")


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """digest, weight (linked documents), links (linked classes), least (least digest that the task's links reach), by task."""
    named = candidates.withColumn("task", F.expr("uuid()"))
    named = stored(named, "ngram-candidates")
    members = named.select("task", F.posexplode("digests").alias("k", "digest")).join(sets, "digest")
    whole = members.groupBy("task").agg(F.collect_list(F.struct("k", "digest", "copies", "grams")).alias("members")).join(named.select("task", "a", "b"), "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"digest": [], "weight": [], "links": [], "least": []}
            for members, a, b in zip(*(batch.column(c) for c in range(3))):
                # Repeated rows of one id and text give their set twice.
                members = [m for _, m in sorted({m["k"]: m for m in members.as_py()}.items())]
                grams = [np.frombuffer(m["grams"], dtype=np.uint64) for m in members]
                names, copies = [m["digest"] for m in members], [m["copies"] for m in members]
                a, b = np.frombuffer(a.as_py(), dtype=np.int32), np.frombuffer(b.as_py(), dtype=np.int32)
                weight, links, root = [0] * len(names), [0] * len(names), list(range(len(names)))
                for x, y in zip(a.tolist(), b.tolist()):
                    lo, hi = sorted((len(grams[x]), len(grams[y])))
                    if lo >= threshold * hi and jaccard(grams[x], grams[y]) >= threshold:
                        for p, q in ((x, y), (y, x)):
                            weight[p] += copies[q]
                            links[p] += 1
                        p, q = _root(root, x), _root(root, y)
                        root[p] = root[q] = min(p, q, key=names.__getitem__)
                for k, n in enumerate(links):
                    if n:
                        for c, v in zip(out, (names[k], weight[k], n, names[_root(root, k)])):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(out["digest"], pa.binary()), "weight": pa.array(out["weight"], pa.int64()), "links": pa.array(out["links"], pa.int64()), "least": pa.array(out["least"], pa.binary())})

    return whole.select("members", "a", "b").mapInArrow(run, "digest binary, weight long, links long, least binary")


def _groups(edges: DataFrame) -> DataFrame:
    """digest -> label: the least digest that is reached over edges (digest, least). Each round sets every class to the
    least label of its neighbours and then to its label's label, so the number of rounds is logarithmic in practice."""
    both = stored(edges.union(edges.select("least", "digest")).distinct().toDF("u", "v"), "ngram-edges")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "ngram-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        low = labels.join(near, "u").select("u", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = stored(low.join(up, "label", "left").select("u", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "ngram-labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, text_hash, copy_class and class_id (least doc_id of copies and of the group), n_links
    (other documents with Jaccard >= threshold), n_class_links (other classes of copies)."""
    with scratch(docs.sparkSession):
        rows = stored(sketches(docs, doc_id, text), "ngram-sketches")
        classes = rows.where("digest is not null").groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
        classes = stored(classes, "ngram-classes")
        candidates = stored(_candidates(classes, threshold, tolerance), "ngram-pruned")
        active = candidates.select(F.explode("digests").alias("digest")).distinct()
        sets = _sets(docs, classes.drop("signature").join(active, "digest", "left_semi"), doc_id, text)
        links = stored(_verified(candidates, sets, threshold), "ngram-links")
        groups = _groups(links.select("digest", "least"))
        linked = links.groupBy("digest").agg(F.sum("weight").alias("weight"), F.sum("links").alias("n_class_links"))
        known = classes.select("digest", "first", "copies").join(linked, "digest", "left").join(groups.select(F.col("u").alias("digest"), "label"), "digest", "left")
        known = known.where("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "digest"))
        heads = known.groupBy("label").agg(F.min("first").alias("head"))
        known = known.join(heads, "label").select(
            "digest", "head", F.col("first.doc_id").alias("copy_class"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links")
        )
        joined = rows.select("doc_id", "text_hash", "digest").join(known, "digest", "left")
        classed = joined.select(
            "doc_id",
            "text_hash",
            F.coalesce("copy_class", "doc_id").alias("copy_class"),
            F.coalesce("head", _order()).alias("head"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"),
        ).select("doc_id", "text_hash", "copy_class", F.col("head.doc_id").alias("class_id"), "head", "n_links", "n_class_links")
        return kept(classed, "ngram-result")



def report(docs: DataFrame) -> DataFrame:
    return similarity_classes(docs.select("doc_id", "text")).select("doc_id", "class_id", "copy_class", "n_links", "n_class_links")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: the first of each group. Repeated rows of one id and text leave one row."""
    found = similarity_classes(docs, doc_id, text)
    first = found.where(_order() == F.col("head")).select(F.col("doc_id").alias("__id__"), F.col("text_hash").alias("__hash__")).distinct()
    keyed = docs.withColumn("__hash__", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = keyed.join(first, (keyed["__hash__"] == first["__hash__"]) & F.col(doc_id).cast("long").eqNullSafe(F.col("__id__")), "left_semi")
    return kept.dropDuplicates([doc_id, "__hash__"]).drop("__hash__")
