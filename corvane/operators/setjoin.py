"""Similarity join of texts by their character shingles: size classes, shared parts of the sets, verification.

Rows with equal shingle sets are collapsed into classes first. Two sets of sizes a and b with a Jaccard of at least t differ in at
most (1 - t) / (1 + t) * (a + b) shingles. If the shingles are dealt into more parts than that by their hash, some parts of both sets
are equal, so sets are joined by (size class, part, hash of the shingles in the part). A part holds several shingles, so
it is far rarer than one: prefixes of single shingles, rarest first, gave some 40 times the work here, since no run of five
characters is rare in a large corpus. A small set speaks of its parts, and there are 2q parts beyond those needed, so that each set may leave out its
q parts that tell least (empty ones, or few frequent shingles by a table of counts) and still at least one equal part
remains to both. That would be a row for every few characters of a long text, though more than a third of the parts of a pair just at the
threshold are equal. So a large set speaks of so many parts only that the chance that none of them is equal is below ``MISS``, whatever its size.

The parts of a set travel in one row until copies are gone; rows of parts that no other set has go before the join, which is
an equi-join that Spark's adaptive planner can split. The rows that are left bear a sketch of ``SKETCH`` bits, so that pairs of sets that
have little more than a part in common don't leave the join, and fingerprints of the set's first parts, so that near copies, which have dozens of
parts in common, leave it about twice and not for each part. Texts are read again, and move only for candidates: to the chunks that these are
dealt into, once to each, not once for each candidate. There they are verified on whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept, scratch, stored

#: Entries of the table of shingle counts that each task gets.
SLOTS = 1 << 16
#: Share of the least number of parts that a set may leave out.
SPARE = 0.25
#: Bits of the sketches, a multiple of 64.
SKETCH = 256
#: Texts of either side of a chunk of candidates, about.
CHUNK = 128
#: 32-bit fingerprints of the first parts travel with rows of parts that more than ``FEW`` sets have: of a pair of which so many agree before a part, this one doesn't speak again.
LANES, AGREED, FEW = 20, 2, 8
#: Keys that are sent to all tasks, so that sets and texts needn't be shuffled to be chosen by key.
SENT = 1 << 21
#: Chance that a pair of large sets just at the threshold has no part in common, and that the sketches of a pair at the threshold differ in
#: more bits than allowed. Sets of up to some 300 shingles, at 0.85, are missed by neither.
MISS = 1e-12
#: Shingles of a large set's part, as a multiple of those with one differing shingle in a part on average; sets of so many
#: shingles, among which chance has more in common and sketches are full, have parts of twice as many.
WIDTH, FULL = 1.0, 6000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def squeezed(text: Column) -> Column:
    """Marks around emphasised text and all white space go; null is empty."""
    return T.without_space(T.strip_marks(F.coalesce(text, F.lit(""))))


def hashed_shingles(text: str, n: int, tag: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the windows of n characters; of a shorter text, of the whole; none of an empty one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, dtype=np.uint64)
    width = min(n, len(codes))
    h = np.full(len(codes) - width + 1, width + (tag << 8), dtype=np.uint64)
    for k in range(width):
        h = (h ^ codes[k : len(codes) - width + 1 + k]) * _ODD
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _tagged(texts: tuple[str, ...], n: int) -> np.ndarray:
    parts = [hashed_shingles(t, n, k) for k, t in enumerate(texts)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _map(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """``mapInArrow`` by batch: ``fn`` gets the columns as lists (texts) or arrays and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in fn(*batch.columns)], names)

    return df.mapInArrow(run, schema)


def _digest(s: np.ndarray) -> tuple[int, int]:
    both = np.array([np.bitwise_xor.reduce(s * _MIX), (s ^ (s >> np.uint64(31))).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def sketch(s: np.ndarray) -> np.ndarray:
    """A bit of the least hash of each of ``SKETCH`` bins (0 of an empty one), as whole numbers of 64 bits; ``s`` is sorted."""
    least = np.zeros(SKETCH, dtype=np.uint64)
    least[((s[::-1] >> np.uint64(40)) % np.uint64(SKETCH)).astype(np.int64)] = s[::-1]  # the last one that is written is the least
    return np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)


def allowed(threshold: float) -> int:
    """Bits in which the sketches of a pair may differ, by Chernoff's bound. The least hashes are drawn from both sets' union without replacement; one that only
    one of the sets has changes a bit with a chance of a half."""
    p = (1 - threshold) / 2
    apart = lambda q: q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
    bits = math.ceil(SKETCH * p)
    while bits < SKETCH and math.exp(-SKETCH * apart((bits + 1) / SKETCH)) > MISS:
        bits += 1
    return bits


def sent(keys: DataFrame) -> DataFrame:
    """Stored keys, to be sent to all tasks unless they are many."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def classes(digested: DataFrame) -> DataFrame:
    """key, class_id: the least key of those with the same digests (a, b) and size n of their sets."""
    least = digested.groupBy("a", "b", "n").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("c"))
    # Only sets that stand more than once need the join back.
    shared = least.where("c > 1").drop("c")
    return kept(digested.join(shared, ["a", "b", "n"], "left").select("key", F.coalesce("class_id", "key").alias("class_id")), "set-classes")


def _weights(rows: DataFrame, n: int) -> np.ndarray:
    """How often each slot of the shingles' hashes is hit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns[1:])):
                total += np.bincount((_tagged(own, n) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "c": pa.array(total[at])})

    found = rows.mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # SLOTS rows at most
    weights = np.zeros(SLOTS, dtype=np.float64)
    weights[found["slot"].to_numpy()] = found["c"].to_numpy()
    return weights


def _at_least(mean: float, least: int) -> float:
    """Chance of so many shingles in a part that holds ``mean`` on average."""
    return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))


@dataclass(frozen=True, eq=False)
class Parts:
    """How sets of each size are dealt into parts, for a threshold."""

    threshold: float
    #: What a shingle of each slot tells: the negative logarithm of its slot's share.
    tells: np.ndarray

    def class_of(self, size: int) -> int:
        """Sizes of a class differ by less than the threshold squared; pairs meet in the smaller one's class."""
        ratio = -2 * math.log(self.threshold)
        g = int(math.log(size) / ratio)
        while self.first(g + 1) <= size:
            g += 1
        while self.first(g) > size:
            g -= 1
        return g

    def first(self, g: int) -> int:
        """The least size of a class."""
        return math.ceil(self.threshold ** (-2 * g) - 1e-9)

    def most(self, g: int) -> int:
        """Shingles in which a pair of class g at the threshold differs at most."""
        return math.floor((self.first(g + 1) - 1) * (1 - self.threshold) / self.threshold + 1e-9)

    def spare(self, g: int) -> int:
        return math.ceil(SPARE * (self.most(g) + 1))

    @functools.cache  # noqa: B019
    def drawn(self, g: int) -> tuple[int, int, int]:
        """Parts of a large set of class g, how many it speaks of, and the shingles that such a part has at least."""
        width = WIDTH * (2 if self.first(g + 1) >= FULL else 1)
        parts = max(1, round((self.most(g) + 1) / width))
        least = max(1, round(width * self.threshold / (1 - self.threshold) / 2))
        odds = []
        for a in (self.first(g), self.first(g + 1) - 1):
            for b in (a, a / self.threshold):
                union = (a + b) / (1 + self.threshold)
                odds.append(math.exp(-(1 - self.threshold) * union / parts) * _at_least(self.threshold * union / parts, least))
        return parts, math.ceil(math.log(MISS) / math.log(1 - min(odds))), least

    def small(self, g: int) -> bool:
        """Whether sets of class g speak of all parts but the spare ones."""
        return self.most(g) + 1 + self.spare(g) <= self.drawn(g)[1]

    def _dealt(self, s: np.ndarray, deal: int, parts: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles in the first ``upto`` parts of a dealing, the part of each, and the parts' hashes."""
        h = s if not deal else (s ^ (s >> np.uint64(23))) * (_ODD + np.uint64(2 * deal))
        at = ((h >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
        if upto < parts:
            s, at = s[at < upto], at[at < upto]
        held = np.zeros(upto, dtype=np.uint64)
        np.add.at(held, at, (s ^ (s >> np.uint64(29))) * _MIX)
        return s, at, held

    def keys(self, s: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the parts that a set speaks of in class g, and the parts' numbers."""
        if self.small(g):
            spare = self.spare(g)
            parts = self.most(g) + 1 + 2 * spare
            _, at, held = self._dealt(s, 0, parts, parts)
            told = np.bincount(at, weights=self.tells[(s & np.uint64(SLOTS - 1)).astype(np.int64)], minlength=parts)
            speaks = np.sort(np.argpartition(told, spare)[spare:])
        else:
            parts, wanted, least = self.drawn(g)
            found, told = [], []
            for deal in range(-(-wanted // parts)):
                upto = min(parts, wanted - deal * parts)
                _, at, own = self._dealt(s, deal, parts, upto)
                found.append(own)
                told.append(np.bincount(at, minlength=upto))
            held, speaks = np.concatenate(found), np.flatnonzero(np.concatenate(told) >= least)
        held = ((held ^ (np.arange(len(held), dtype=np.uint64) + np.uint64(g << 32))) + _ODD) * _MIX
        held ^= held >> np.uint64(31)
        return held[speaks], speaks


def similar_pairs(rows: DataFrame, key: str, texts: list[str], threshold: float = 0.85, n: int = 5, signed: Callable[[str], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (i < j, similarity) of class representatives of which each of ``texts`` has a Jaccard of at least the threshold, and
    the membership (key, class_id) of all rows. ``similarity`` is that of the last text. With ``signed``, which makes a squeezed text's signature, pairs
    have ``estimate`` as well: the share of the places in which the signatures of their last texts agree.

    Keys are whole numbers. Rows with a null key or an empty (or null) text are in no pair and no class; a key that repeats counts as one row with its
    texts in any order. Several texts are joined through the union of their sets, each with shingles of its own: if each pair of sets
    reaches the threshold, so does that of the unions. A pair of large sets just at the threshold is missed with a chance below twice ``MISS``.
    """
    names = [f"t{k}" for k in range(len(texts))]
    made = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), *[squeezed(F.col(t)).alias(x) for x, t in zip(names, texts)])
    made = made.where(" and ".join(f"{x} <> ''" for x in names))
    # The table is for small sets only: those of long texts leave no part out for what it tells.
    plain = Parts(threshold, np.zeros(SLOTS))
    top = next(g for g in range(1 << 20) if not plain.small(g))
    chars = sum((F.char_length(x) for x in names), F.lit(0))
    weights = _weights(made.where(chars < plain.first(top + 1) + n * len(names)), n)
    dealt = Parts(threshold, -np.log((weights + 1) / (max(1.0, float(weights.sum())) + SLOTS)))

    words = [f"s{k}" for k in range(SKETCH // 64)]
    kinds = [("key", "long"), ("a", "long"), ("b", "long"), ("n", "int"), *[(w, "long") for w in words], ("parts", "array<long>"), ("spoken", "int")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}

    def spoken(keys: pa.Array, *columns: pa.Array) -> tuple:
        out: list[list] = [[] for _ in kinds]
        for k, own in zip(keys.to_pylist(), zip(*(c.to_pylist() for c in columns))):
            s = _tagged(own, n)
            g, drawn = dealt.class_of(len(s)), sketch(s).tolist()
            for c in (g, g - 1) if g and threshold * len(s) < dealt.first(g) else (g,):
                held, speaks = dealt.keys(s, c)
                # Null where the set visits the class below its own.
                home = (*_digest(s), len(s)) if c == g else (None,) * 3
                row = (k, *home, *drawn, held.view(np.int64), int((1 << speaks[speaks < LANES]).sum()))
                for column, x in zip(out, row):
                    column.append(x)
        return tuple(pa.array(x, arrow[kind]) for x, (_, kind) in zip(out, kinds))

    # The table of all parts goes as soon as those in common are known.
    with scratch(rows.sparkSession):
        # A row for each set and class; that of its own class has the digests. ``spoken`` has a bit for each of the first ``LANES`` parts that the set speaks of.
        sets = stored(_map(made, spoken, ", ".join(f"{x} {kind}" for x, kind in kinds)), "set-parts")
        home = sets.where("n is not null")
        members = classes(home.select("key", "a", "b", "n"))
        copies = stored(members.groupBy("key").agg(F.bool_or(F.col("class_id") == F.col("key")).alias("head")).where("not head").select("key"), "set-copies")

        visits = F.col("n").isNull().alias("visits")
        each = sets.join(sent(copies), "key", "left_anti").select("key", visits, F.posexplode("parts").alias("at", "part"))
        each = each.select("part", "key", (F.least("at", F.lit(LANES)) * 2 + F.col("visits").cast("int")).alias("tag"))
        # Most parts are one set's alone; only the others get the sketches and fingerprints.
        shared = each.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("part"))).where("c > 1")
        shared = shared.select("part", "key", (F.col("tag") % 2 == 1).alias("visits"), F.when(F.col("c") > FEW, F.shiftright("tag", 1)).otherwise(0).alias("at"))
        # Lane k is the fingerprint of part k, or 0 if the set doesn't speak of it; two go into a whole number. Parts that come before part k in the row.
        before = [F.bit_count(F.col("spoken").bitwiseAND((1 << k) - 1)) for k in range(LANES)]
        speaks = [F.col("spoken").bitwiseAND(1 << k) != 0 for k in range(LANES)]
        prints = [F.when(speaks[k], F.get("parts", before[k]).bitwiseAND(0xFFFFFFFF)).otherwise(F.lit(0).cast("long")) for k in range(LANES)]
        lanes = [f"l{k}" for k in range(LANES // 2)]
        packed = [prints[2 * k].bitwiseOR(F.shiftleft(prints[2 * k + 1], 32)).alias(x) for k, x in enumerate(lanes)]
        borne = sets.select("key", visits, "spoken", *words, *packed).dropDuplicates(["key", "visits"])
        # Only lanes of parts before the row's own count.
        mine = [F.when(before[k] < F.col("at"), F.lit(-1 << 32 if k % 2 else 0xFFFFFFFF)).otherwise(F.lit(0)).cast("long") for k in range(LANES)]
        held = [F.col(x).bitwiseAND(mine[2 * k].bitwiseOR(mine[2 * k + 1])).alias(x) for k, x in enumerate(lanes)]
        index = kept(shared.join(borne, ["key", "visits"]).select("part", "key", "visits", *words, *held), "set-index")
    pairs = stored(_met(index, words, lanes, threshold).distinct(), "set-candidates")
    return _verified(pairs, made, names, threshold, n, signed), members


def _met(index: DataFrame, words: list[str], lanes: list[str], threshold: float) -> DataFrame:
    """i, j of the sets with a part in common and sketches near each other; of near copies about twice, whatever the number of their parts."""
    a, b = (index.toDF("part", x, f"v{x}", *[f"{w}{x}" for w in [*words, *lanes]]) for x in "ij")
    apart = sum((F.bit_count(F.col(f"{w}i").bitwiseXOR(F.col(f"{w}j"))) for w in words), F.lit(0))
    lane = lambda c, k: F.shiftrightunsigned(F.col(c), 32) if k else F.col(c).bitwiseAND(0xFFFFFFFF)
    agreed = sum((((lane(f"{x}i", k) != 0) & (lane(f"{x}i", k) == lane(f"{x}j", k))).cast("int") for x in lanes for k in (0, 1)), F.lit(0))
    # Two that visit a class meet in their own as well.
    return a.join(b, "part").where("i < j and not (vi and vj)").where((apart <= allowed(threshold)) & (agreed < AGREED)).select("i", "j")


def _verified(pairs: DataFrame, made: DataFrame, names: list[str], threshold: float, n: int, signed: Callable[[str], np.ndarray] | None) -> DataFrame:
    """i, j, similarity (and estimate) of the candidates (i < j) of which each text has a Jaccard of at least the threshold.

    A candidate goes to the group of the least set that its first one is a candidate with, so those among near copies of one text are one group. Groups are
    dealt into chunks by both sides, so no task holds more than some ``CHUNK`` texts of either; a text goes to each chunk once. Only texts of pairs that pass are
    signed, where they are, so signatures aren't moved.
    """
    groups = pairs.groupBy(F.col("j").alias("i")).agg(F.min("i").alias("g"))
    grouped = stored(pairs.join(groups, "i", "left").select(F.coalesce("g", "i").alias("g"), "i", "j"), "set-groups")
    # Estimates are enough: they change the chunks, not the result. Only the few groups of more than one chunk are joined back, so that a large one isn't gathered.
    sizes = grouped.groupBy("g").agg(*[F.ceil(F.approx_count_distinct(x) / CHUNK).alias(f"n{x}") for x in "ij"])
    sizes = sent(stored(sizes.where("ni > 1 or nj > 1"), "set-sizes"))
    dealt = grouped.join(sizes, "g", "left").select("g", *[F.pmod(F.xxhash64(x), F.coalesce(f"n{x}", F.lit(1))).alias(f"c{x}") for x in "ij"], "i", "j")
    dealt = stored(dealt, "set-chunks")
    chunk = ["g", "ci", "cj"]
    wanted = dealt.select(*chunk, F.explode(F.array("i", "j")).alias("key")).distinct()
    paired = stored(wanted.select("key").distinct(), "set-paired")
    held = made.join(sent(paired), "key", "left_semi").dropDuplicates(["key"])
    moved = wanted.join(held, "key").select(*chunk, "key", *names).toDF("sg", "si", "sj", "key", *names)

    def verified(candidates: pa.Table, texts: pa.Table) -> pa.Table:
        sets = {k: [hashed_shingles(t, n) for t in own] for k, *own in zip(*(texts[x].to_pylist() for x in ("key", *names)))}
        keep, sims = [], []
        for at, (i, j) in enumerate(zip(candidates["i"].to_pylist(), candidates["j"].to_pylist())):
            sim = 0.0
            for x, y in zip(sets[i], sets[j]):
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    break
                common = len(np.intersect1d(x, y, assume_unique=True))
                sim = common / (len(x) + len(y) - common)
                if sim < threshold:
                    break
            else:
                keep.append(at)
                sims.append(sim)
        found = candidates.select(["i", "j"]).take(pa.array(keep, pa.int64()))
        found = found.append_column("similarity", pa.array(sims, pa.float64()))
        if not signed:
            return found
        last = dict(zip(texts["key"].to_pylist(), texts[names[-1]].to_pylist()))
        marks = functools.cache(lambda k: signed(last[k]))
        agreed = [float((marks(i) == marks(j)).mean()) for i, j in zip(found["i"].to_pylist(), found["j"].to_pylist())]
        return found.append_column("estimate", pa.array(agreed, pa.float64()))

    schema = "i long, j long, similarity double" + (", estimate double" if signed else "")
    return dealt.groupBy(*chunk).cogroup(moved.groupBy("sg", "si", "sj")).applyInArrow(verified, schema)


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows (i < j, similarity and what else class pairs have, which is 1 of copies) that class pairs and copies stand for; as many as the square
    of a class's size, so only for results known to be small."""
    facts = [c for c in pairs.columns if c not in ("i", "j")]
    copies = members.toDF("i", "c").join(members.toDF("j", "c"), "c").where("i < j").select("i", "j", *[F.lit(1.0).alias(x) for x in facts])
    a, b = members.toDF("x", "i"), members.toDF("y", "j")
    across = pairs.join(a, "i").join(b, "j").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), *facts)
    return across.unionByName(copies)


def linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """key, class_id and n_links of each row: the other rows that are its copies or paired with its class."""
    sizes = stored(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("c")), "class-sizes")
    # Not a union, which would verify the pairs twice.
    ends = [F.struct(F.col(x).alias("class_id"), F.col(y).alias("other")) for x, y in ("ij", "ji")]
    both = pairs.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
    others = both.join(sizes.toDF("other", "c"), "other").groupBy("class_id").agg(F.sum("c").alias("l"))
    counted = sizes.join(others, "class_id", "left").select("class_id", (F.col("c") - 1 + F.coalesce("l", F.lit(0))).alias("n_links"))
    return members.join(counted, "class_id").select("key", "class_id", "n_links")
