"""Near vectors by random planes: signatures in several tables, probes of the bits that are least sure, exact verification.

Two unit vectors with cosine t fall on the same side of a random plane with chance 1 - acos(t) / pi, whatever their
dimension. A table's key are the sides of a few planes; each row also takes the keys with one of its least sure sides turned.
The number of tables follows from the chance, found by simulation, that a pair just at the threshold shares a key in one of
them. Equal vectors are collapsed first. Planes are added until the buckets of most rows of a sample are small; buckets that
stay large (many vectors that are near each other) are dealt into blocks, of which each pair is compared. Nothing is dropped,
and no task compares more than two blocks at once. Candidates pass a bound on differing sides before their vectors meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from ..session import stored

#: Rows compared with each other at once.
BUCKET = 256
#: Chance that a pair just at the threshold is missed; pairs above it are missed less often.
MISS = 1e-4
#: Least sure sides that are turned, one at a time.
TURNED = 4
#: Rows by which the number of planes is chosen (which changes the work, not the result), and its limits.
SAMPLE, PLANES = 4096, range(2, 25)
#: Tables whose keys travel along, so that a pair speaks only in the first of them that both are in.
FIRST = 8
#: Words of 64 sides by which candidates are bounded, and the bound's distance from the mean in standard deviations.
WORDS, DEVIATIONS = 4, 5.0


@functools.cache
def shared_key(threshold: float, bits: int, turned: int = TURNED, trials: int = 40_000) -> float:
    """Chance that a pair with this cosine shares a key in a table of ``bits`` planes, by simulation."""
    r = np.random.default_rng(1)
    a = r.standard_normal((trials, bits))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * r.standard_normal((trials, bits))
    differ = (a > 0) != (b > 0)
    weak = [np.argsort(np.argsort(np.abs(x), axis=1), axis=1) < turned for x in (a, b)]
    n, (wa, wb) = differ.sum(axis=1), [(differ & w).sum(axis=1) for w in weak]
    two = (n == 2) & (wa >= 1) & (wb >= 1) & ((differ & (weak[0] | weak[1])).sum(axis=1) == 2)
    return float(((n == 0) | ((n == 1) & (wa + wb > 0)) | two).mean())


def tables_for(threshold: float, bits: int, miss: float = MISS) -> int:
    p = shared_key(threshold, bits)
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log(1 - max(p, 1e-6)))


def bits_for(sample: np.ndarray, rows: int, bucket: int = BUCKET) -> int:
    """The fewest planes with which the bucket of the median row gets a quarter of ``bucket`` rows at most."""
    sides = sample @ np.random.default_rng(2).standard_normal((sample.shape[1], PLANES[-1])) > 0
    for bits in PLANES:
        _, at, n = np.unique(sides[:, :bits] @ (1 << np.arange(bits)), return_inverse=True, return_counts=True)
        if np.median(n[at]) / len(sample) * rows * (1 + TURNED) <= bucket / 4:
            break
    return bits


def _keyed(rows: DataFrame, dimension: int, bits: int, tables: int) -> DataFrame:
    """bucket, id, sides: a row for each table and probed key of (id, v)."""
    planes = np.random.default_rng(1).standard_normal((dimension, tables * bits))
    sides = np.random.default_rng(0).standard_normal((dimension, 64 * WORDS))
    powers = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // (tables * (1 + TURNED)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                ids, v = part.column(0).to_numpy(), matrix(part.column(1), dimension)
                at = (v @ planes).reshape(len(v), tables, bits)
                own = ((at > 0) * powers).sum(axis=2)
                weak = np.argsort(np.abs(at), axis=2)[:, :, : min(TURNED, bits)]
                codes = np.concatenate([own[:, :, None], own[:, :, None] ^ powers[weak]], axis=2)
                keys = (codes + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]).reshape(len(v), -1)
                masks = (powers[weak]).sum(axis=2)
                travel = np.stack([own[:, :FIRST], masks[:, :FIRST]], axis=2).astype(np.int32).reshape(len(v), -1)
                words = np.concatenate([np.packbits(v @ sides > 0, axis=1), travel.view(np.uint8)], axis=1)
                each, width = np.repeat(np.arange(len(v)), keys.shape[1]), words.shape[1]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(each), [None, pa.py_buffer(words[each].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids[each]), packed], ["bucket", "id", "sides"])

    return rows.mapInArrow(run, "bucket long, id long, sides binary")


def _speaks(bucket: np.ndarray, bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs in a bucket, whether this is where they speak: not if they share a key in an earlier table, nor in the same
    table a key that comes before. ``a`` and ``b`` are (pairs, tables, own key and turned sides), the smaller id first."""
    table, code = bucket >> bits, (bucket & ((1 << bits) - 1)).astype(np.int32)
    differ, wa, wb = a[:, :, 0] ^ b[:, :, 0], a[:, :, 1], b[:, :, 1]
    n = np.bitwise_count(differ)
    da, db = differ & wa, differ & wb
    meet = (n == 0) | ((n == 1) & ((da | db) != 0)) | ((n == 2) & (da != 0) & (db != 0) & ((da | db) == differ))
    tables = np.arange(meet.shape[1])
    late = (meet & (tables[None, :] < table[:, None])).any(axis=1)
    here = np.flatnonzero(table < meet.shape[1])
    k = table[here]
    own, n, d, x, y = a[here, k, 0], n[here, k], differ[here, k], da[here, k], db[here, k]
    low = d & -d
    high = d ^ low
    # Keys that both have: their own if it is one, else those that a turned side of either leads to.
    by_low, by_high = ((x & low) != 0) & ((y & high) != 0), ((x & high) != 0) & ((y & low) != 0)
    two = np.where(by_low & by_high, np.minimum(own ^ low, own ^ high), np.where(by_low, own ^ low, own ^ high))
    first = np.where(n == 0, own, np.where(n == 1, np.where(x != 0, own ^ d, own), two))
    speaks = ~late
    speaks[here] &= code[here] == first
    return speaks


def _compared(groups: DataFrame, keys: list[str], most: int, bits: int) -> DataFrame:
    """Pairs i < j of rows (keys..., part, id, sides) that stand together, differ in at most ``most`` sides and speak here. Rows of two
    parts of a block pair meet only across."""

    def pairs(own: np.ndarray, run_at: np.ndarray, part: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends, at = np.searchsorted(run_at, run_at, side="right"), np.arange(len(run_at))
        words = np.ascontiguousarray(rows[:, : 8 * WORDS]).view(np.uint64)
        travel = np.ascontiguousarray(rows[:, 8 * WORDS :]).view(np.int32).reshape(len(rows), -1, 2)
        cross = own[:, 1] != own[:, 2]
        for d in range(1, int((ends - at).max(initial=1))):
            a = np.flatnonzero(ends - at > d)
            b = a + d
            fit = (~cross[a] | (part[a] != part[b])) & (ids[a] != ids[b])
            a, b = a[fit], b[fit]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= most
            a, b = a[near], b[near]
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            real = _speaks(own[a, 0], bits, travel[a], travel[b])
            if real.any():
                yield pa.RecordBatch.from_pydict({"i": ids[a[real]], "j": ids[b[real]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy() for k in range(len(keys))], axis=1)
            part, ids = batch.column(len(keys)).to_numpy(), batch.column(len(keys) + 1).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(len(keys) + 2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            if rest is not None:
                own, part, ids, rows = (np.concatenate([x, y]) for x, y in zip(rest, (own, part, ids, rows)))
            run_at = np.concatenate([[0], np.cumsum((own[1:] != own[:-1]).any(axis=1))])
            last = int(np.searchsorted(run_at, run_at[-1]))
            rest = own[last:], part[last:], ids[last:], rows[last:]
            yield from pairs(own[:last], run_at[:last], part[:last], ids[:last], rows[:last])
        if rest is not None:
            own, part, ids, rows = rest
            yield from pairs(own, np.zeros(len(ids), dtype=np.int64), part, ids, rows)

    return groups.mapInArrow(run, "i long, j long")


def vector_classes(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The first row (key, v) of each class of rows with equal vectors, and the membership (key, class_id) of all rows.

    Keys are whole numbers. Rows with a null key, a null, empty or zero vector, or one with null or non-finite entries
    are in no class; neither are rows of another dimension than most (the larger on a tie).
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    clean = rows.where(F.col(key).isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(key).cast("long").alias("key"), v.cast("array<double>").alias("v"))
    names = stored(clean.select("key", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), F.size("v").alias("d")), "plane-digests")
    common = names.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    names = names.where(F.col("d") == (common["d"] if common else 1))
    least = names.groupBy("a", "b").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("c"))
    members = stored(names.join(least.where("c > 1").drop("c"), ["a", "b"], "left").select("key", F.coalesce("class_id", "key").alias("class_id")), "plane-classes")
    held = stored(clean.join(members.select(F.col("class_id").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]), "plane-rows")
    return held, members


def near_pairs(rows: DataFrame, key: str, vector: str, threshold: float, miss: float = MISS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Pairs (i < j, similarity) of class representatives with a cosine of at least the threshold, and the membership
    (key, class_id) of all rows; a class is rows with equal vectors, named by its least key (see ``vector_classes``).

    Of the pairs just at the threshold a share of about ``miss`` isn't found, and less above it; ``dedup.dense_pairs`` is the exact
    form.
    """
    held, members = vector_classes(rows, key, vector)
    n = held.count()
    if not n:
        return members.select(F.col("key").alias("i"), F.col("key").alias("j"), F.lit(0.0).alias("similarity")).limit(0), members
    dimension = len(held.first()["v"])
    sample = np.array([r["v"] for r in held.orderBy(F.xxhash64("key")).limit(SAMPLE).collect()])
    bits = bits_for(sample, n, bucket)
    keyed = stored(_keyed(held, dimension, bits, tables_for(threshold, bits, miss)), "plane-keys")
    large = stored(keyed.groupBy("bucket").count().where(F.col("count") > bucket), "plane-large")
    zero = F.lit(0).cast("long")
    groups = keyed.select("bucket", zero.alias("lo"), zero.alias("hi"), zero.alias("part"), "id", "sides")
    if large.limit(1).count():
        dealt = keyed.join(large, "bucket").withColumn("parts", F.ceil(F.col("count") / bucket)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        dealt = dealt.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "sides")
        groups = groups.join(large, "bucket", "left_anti").unionByName(dealt)
    odds = math.acos(min(1.0, threshold)) / math.pi
    most = math.ceil(64 * WORDS * odds + DEVIATIONS * math.sqrt(64 * WORDS * odds * (1 - odds)))
    ordered = groups.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    pairs = stored(_compared(ordered, ["bucket", "lo", "hi"], most, bits).distinct(), "plane-pairs")
    return verified(pairs, held, threshold), members


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (i, j) whose vectors (id, v) have a cosine of at least the threshold, with it."""
    both = pairs.join(vectors.toDF("i", "x"), "i").join(vectors.toDF("j", "y"), "j").select("i", "j", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (matrix(batch.column(k)) for k in (2, 3))
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                at = pa.array(np.flatnonzero(cosine >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cosine).take(at)], ["i", "j", "similarity"])

    return both.mapInArrow(run, "i long, j long, similarity double")
