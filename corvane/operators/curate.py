"""Curation: enum repair, hygiene cascade, rubric gate, lookups, overlap with protected text, stratified split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Closed domains and their known misspellings.
PATTERNS = ["reflection_reframing", "diagnostic", "tension_escalation", "aphorism", "philosophical_explanation", "misconception_correction", "contrast", "self_narrative", "safe_redirect"]
PATTERN_FIXES = {"reflection_refframing": "reflection_reframing", "reflection-reframing": "reflection_reframing"}
CONCEPTS = ["nihilism", "value_creation", "self_overcoming_health", "morality_ressentiment", "mass_culture_solitude", "power", "eternal_recurrence", "decadence", "art_tragedy"]
CONCEPT_FIXES = {
    "self-overcoming-health": "self_overcoming_health",
    "self_overcoming": "self_overcoming_health",
    "value-creation": "value_creation",
    "morality-ressentiment": "morality_ressentiment",
    "mass-culture-solitude": "mass_culture_solitude",
    "eternal-recurrence": "eternal_recurrence",
    "art-tragedy": "art_tragedy",
}
QUESTION_TYPES = ["existential_question", "philosophical_question", "biographical_question"]
DIFFICULTIES = ["easy", "medium", "hard"]
# Constants of each work.
VOICES = {"JW": "contemplative_aphorism", "BGE": "polemical_sharp", "GM": "polemical_sharp", "TI": "hammer_intensified", "EH": "hammer_intensified"}
PERIODS = {"JW": "middle", "BGE": "late", "GM": "late", "TI": "final", "EH": "final"}
# Response patterns that each use case allows.
USE_CASE_PATTERNS = {
    "existential": ["reflection_reframing", "diagnostic", "tension_escalation", "aphorism"],
    "philosophical": ["philosophical_explanation", "misconception_correction", "contrast"],
    "biographical": ["self_narrative", "philosophical_explanation", "contrast", "misconception_correction"],
    "existential+philosophical": ["reflection_reframing", "diagnostic", "tension_escalation", "aphorism", "philosophical_explanation", "misconception_correction", "contrast"],
    "philosophical+biographical": ["philosophical_explanation", "misconception_correction", "contrast", "self_narrative"],
    "existential+biographical": ["reflection_reframing", "diagnostic", "tension_escalation", "aphorism", "self_narrative"],
    "all": ["reflection_reframing", "diagnostic", "tension_escalation", "aphorism", "philosophical_explanation", "misconception_correction", "contrast", "self_narrative"],
}
# The rubric gate as SQL conditions over a, b, c (the three tracks), sc (self-contained), den (density), ch
# (chapter).
GATES = {
    "JW": "(a >= 3 or b >= 3) and sc >= 3 and den >= 2",
    "BGE": "b >= 3 and sc >= 3 and den >= 2",
    "GM": "b >= 4 and sc >= 4 and den >= 3",
    "EH": "(c >= 3 or b >= 3) and sc >= 3",
    "TI": "case when ch = 1 then (a >= 3 or b >= 3) and den >= 3 when ch in (2, 8, 9) then (a >= 3 or b >= 3) and sc >= 3 "
    "when ch between 3 and 7 then b >= 3 and sc >= 3 when ch = 10 then b >= 4 and sc >= 4 when ch = 11 then den >= 4 else false end",
}
#: Characters that a text may not share with protected text.
OVERLAP = 15
#: Characters of protected text that may be sent to all tasks.
BROADCAST_CHARS = 4_000_000


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, else the key."""
    out = value
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def enum_reason(pattern: Column, concept: Column, question: Column, difficulty: Column) -> Column:
    """Reason of the first domain check that fails, else null; a null value fails."""
    checks = (("pattern", pattern, PATTERNS), ("concept", concept, CONCEPTS), ("qtype", question, QUESTION_TYPES), ("difficulty", difficulty, DIFFICULTIES))
    out = F.lit(None).cast("string")
    for name, value, domain in reversed(checks):
        bad = ~F.coalesce(value.isin(domain), F.lit(False))
        out = F.when(bad, F.concat(F.lit(f"invalid_{name}:"), F.coalesce(value, F.lit("None")))).otherwise(out)
    return out


def hygiene_reason(enum: Column, answer: Column, shares: Column, difficulty: Column, comfort: list[str] = T.COMFORT) -> Column:
    """One reason for each row, cheap checks first: domains, empty, overlap, comfort, length."""
    return (
        F.when(enum.isNotNull(), enum)
        .when(F.char_length(T.trim_all(F.coalesce(answer, F.lit("")))) == 0, F.lit("empty_assistant"))
        .when(F.coalesce(shares, F.lit(False)), F.lit("plagiarism"))
        .when(T.any_phrase(answer, comfort), F.lit("comfort"))
        .when(~T.length_ok(answer, difficulty), F.lit("length"))
    )


def gate(work: Column | str = "work") -> Column:
    """Whether a scored chunk passes its work's rubric; columns a, b, c, sc, den, ch."""
    work = F.col(work) if isinstance(work, str) else work
    out = F.lit(False)
    for name, condition in GATES.items():
        out = F.when(work == name, F.coalesce(F.expr(condition), F.lit(False))).otherwise(out)
    return out


def gate_reason() -> Column:
    """Reason of a chunk that doesn't pass, with its scores."""
    number = lambda c: F.col(c).cast("string")
    shown = {"JW": "a b sc den", "BGE": "b sc den", "GM": "b sc den", "TI": "a b sc den", "EH": "b c sc"}
    label = lambda c: c.upper() if len(c) == 1 else c
    out = F.lit(None).cast("string")
    for work, cols in shown.items():
        parts = F.concat_ws(",", *[F.concat(F.lit(f"{label(c)}="), number(c)) for c in cols.split()])
        head = F.concat(F.lit("TI Ch"), number("ch"), F.lit(" fail (")) if work == "TI" else F.lit(f"{work} fail (")
        out = F.when(F.col("work") == work, F.concat(head, parts, F.lit(")"))).otherwise(out)
    return F.when(~gate(), out)


def use_case(a: Column, b: Column, c: Column) -> Column:
    """Three flags as one label; null if none is set."""
    return (
        F.when(a & b & c, "all")
        .when(a & b, "existential+philosophical")
        .when(b & c, "philosophical+biographical")
        .when(a & c, "existential+biographical")
        .when(a, "existential")
        .when(b, "philosophical")
        .when(c, "biographical")
    )


def source_ref(work: Column, essay: Column, chapter: Column, sub: Column, part: Column, number: Column) -> Column:
    """Key of a chunk by its work; a sub-chapter of 0 or null is left out."""
    s = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return (
        F.when(work == "GM", join("GM_e", s(essay), "_s", s(number)))
        .when(work == "TI", join("TI_c", s(chapter), "_s", s(number)))
        .when((work == "EH") & (F.coalesce(sub, F.lit(0)) != 0), join("EH_c", s(chapter), "_sub", s(sub), "_s", s(number)))
        .when(work == "EH", join("EH_c", s(chapter), "_s", s(number)))
        .when(work == "BGE", join("BGE_p", s(part), "_s", s(number)))
        .otherwise(join("JW_s", s(number)))
    )


def lookup_last(left: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, out: str) -> DataFrame:
    """Left join with a lookup in which the last duplicate wins and misses give the empty text."""
    last = table.groupBy(F.col(table_key).alias("__k__")).agg(F.max_by(value, order).alias("__v__"))
    joined = left.join(last, F.col(key) == F.col("__k__"), "left")
    return joined.withColumn(out, F.coalesce("__v__", F.lit(""))).drop("__k__", "__v__")


_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_SLICE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Windows:
    """All windows of n characters of some texts, by a hash that rolls over code points; look-ups are verified."""

    def __init__(self, texts: list[str], n: int):
        self.n = n
        self.up, self.down = _powers(_BASE, _SLICE + n), _powers(pow(_BASE, -1, 2**64), _SLICE + n)
        long = [c for c in map(self.codes, texts) if len(c) >= n]
        self.text = np.concatenate(long) if long else np.zeros(0, dtype=np.uint32)
        starts = np.cumsum([0, *map(len, long)])[:-1]
        places = [np.arange(len(c) - n + 1) + s for c, s in zip(long, starts)]
        hashes = [np.concatenate([h for _, h in self.hashes(c)]) for c in long]
        place, key = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (places, hashes))
        order = np.argsort(key, kind="stable")
        self.keys, self.places = key[order].astype(np.uint64), place[order]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def hashes(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Start and window hashes of slices of bounded size."""
        for at in range(0, len(codes) - self.n + 1, _SLICE):
            part = codes[at : at + _SLICE + self.n - 1].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * self.up[: len(part)])])
            yield at, (sums[self.n :] - sums[: -self.n]) * self.down[: len(part) - self.n + 1]

    def shared(self, text: str) -> bool:
        """Whether the text holds one of the windows."""
        codes = self.codes(text)
        if not len(self.keys):
            return False
        for at, h in self.hashes(codes):
            low = np.searchsorted(self.keys, h)
            for k in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == h):
                own = codes[at + k : at + k + self.n]
                for j in range(low[k], np.searchsorted(self.keys, h[k], side="right")):
                    if np.array_equal(own, self.text[self.places[j] : self.places[j] + self.n]):
                        return True
        return False


def with_overlap(docs: DataFrame, protected: DataFrame, key: str, text: str, protected_text: str, n: int = OVERLAP, out: str = "shares") -> DataFrame:
    """``docs`` with a flag: the text shares a window of n characters with any protected text, marks and white space apart.

    Protected texts of up to ``BROADCAST_CHARS`` characters go to all tasks, which judge each text in one pass without a
    shuffle. Larger ones are joined by the hashes of their windows, with the same result. Null texts share nothing; null and repeated
    keys are judged like others. A column of the caller named ``out`` is replaced.
    """
    squeezed = lambda c: T.without_space(T.strip_marks(F.coalesce(F.col(c), F.lit(""))))
    kept = protected.select(squeezed(protected_text).alias("t")).where(F.char_length("t") >= n).distinct()
    if (kept.agg(F.sum(F.char_length("t"))).first()[0] or 0) > BROADCAST_CHARS:
        # Texts are told apart by their hashes, whatever the keys; texts too short for a window have none and stay as they are.
        own = squeezed(text)
        marked = docs.withColumn("__h__", F.when(F.char_length(own) >= n, F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"))))
        texts = marked.where("__h__ is not null").groupBy("__h__").agg(F.first(own).alias("s"))
        flag = _overlapping(texts, kept, "__h__", n).withColumn("__f__", F.lit(True))
        return marked.join(flag, "__h__", "left").withColumn(out, F.coalesce("__f__", F.lit(False))).select(*[c for c in docs.columns if c != out], out)
    texts = [r["t"] for r in kept.collect()]
    made: list[Windows] = []

    @F.pandas_udf("boolean")
    def shares(column: pd.Series) -> pd.Series:
        if not made:
            made.append(Windows(texts, n))
        return pd.Series([made[0].shared(t) for t in column], dtype=bool)

    return docs.withColumn(out, shares(squeezed(text)))


def _overlapping(texts: DataFrame, protected: DataFrame, key: str, n: int) -> DataFrame:
    """Keys of texts (key, s) that share a window with protected texts (t): hashes find those that may, strings verify them."""
    bad = protected.select(F.explode(T.ngrams(F.col("t"), n)).alias("gram")).distinct()
    hashed = T.let(F.split("s", ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.xxhash64(F.slice(c, i, F.lit(n)))))
    hashes = texts.where(F.char_length("s") >= n).select(key, F.explode(hashed).alias("h"))
    maybe = hashes.join(bad.select(F.xxhash64(F.split("gram", "")).alias("h")), "h", "left_semi").select(key).distinct()
    grams = texts.join(maybe, key, "left_semi").select(key, F.explode(T.ngrams(F.col("s"), n)).alias("gram"))
    return grams.join(bad, "gram", "left_semi").select(key).distinct()


def overlapping(docs: DataFrame, protected: DataFrame, doc_id: str, text: str, protected_text: str, n: int = OVERLAP) -> DataFrame:
    """Ids of texts that share a window of n characters with any protected text."""
    return with_overlap(docs.select(doc_id, text), protected, doc_id, text, protected_text, n).where("shares").select(doc_id)


def remaining(work: DataFrame, done: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Rows whose key isn't done yet; with ``null_safe`` null parts of a key are equal."""
    if not null_safe:
        return work.join(done.select(*keys).distinct(), keys, "left_anti")
    there = done.select(*[F.col(k).alias(f"__{k}__") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}__"))
    return work.join(there, on, "left_anti")


def numbered(df: DataFrame, order: list[str], start: int = 1, out: str = "ordinal") -> DataFrame:
    """Consecutive numbers in a total order without gathering rows in one task: rows are dealt by range, numbered inside
    partitions, and shifted by the sizes of the partitions before."""
    from ..session import stored

    placed = stored(df.repartitionByRange(*order).withColumn("__p__", F.spark_partition_id()), "numbered")
    inside = placed.withColumn("__i__", F.row_number().over(Window.partitionBy("__p__").orderBy(*order)))
    sizes = sorted((r["__p__"], r["count"]) for r in placed.groupBy("__p__").count().collect())
    offsets, total = [], start - 1
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p__ int, __o__ long")
    return inside.join(F.broadcast(shift), "__p__").withColumn(out, (F.col("__i__") + F.col("__o__")).cast("long")).drop("__p__", "__i__", "__o__")
