"""Quality rules: counts of a text, fixed base rules, and a learned decision list.

Everything runs as DataFrame expressions. Counts are taken in one pass without a shuffle. The decision list is learned by
sequential covering: the counts of labelled rows are binned at their quantiles, one aggregation gives the numbers of good
and bad rows in each occupied cell, and rules (conjunctions of thresholds) are grown on one half of the rows, pruned on
the other, and emitted as one ordered conditional expression.

Defined results: null and empty texts have no words, fail the base rules and are not kept; rows without a label don't
train; with fewer than ``MIN_CELL`` bad rows the list is empty and the base rules decide; repeated rows give repeated
results; repeated or conflicting labels count each; an empty table gives an empty table. ``keep`` returns all columns of the
caller's as they are; ``measure`` and ``judge`` replace columns that are named like the counts and verdicts they add.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, symbols and thresholds of the base rules.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Labelled rows used for learning: those of smallest hash, up to this many.
SAMPLE = 20_000
#: Bins of each measure, rules at most, bad rows that a rule must cover, and its precision on rows not used to grow it.
BINS, MAX_RULES, MIN_CELL, PRECISION = 24, 16, 8, 0.95


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows found twice or more, from the hash of the window at each word."""

    def covered(sorted_pairs: Column) -> Column:
        at = lambda i: F.get(sorted_pairs, i)
        twin = lambda i: F.coalesce(at(i)["h"] == at(i - 1)["h"], F.lit(False)) | F.coalesce(at(i)["h"] == at(i + 1)["h"], F.lit(False))
        index = F.sequence(F.lit(0), F.size(sorted_pairs) - 1)
        starts = F.sort_array(F.transform(F.filter(index, twin), lambda i: at(i)["i"]))
        step = lambda p: lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW)))
        return let(starts, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step(p)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text added as columns ``n_words`` to ``n_distinct`` (long)."""
    spaces = f"[{SPACE}]+"
    body = F.coalesce(F.col(text), F.lit(""))
    # Names that can't meet a column of the caller's; removed below.
    w, h = "__words__", "__windows__"
    words = F.filter(F.split(body, spaces), lambda x: x != "")
    first = docs.withColumn(w, words)
    n = F.size(w)
    none = F.array().cast("array<bigint>")
    # Bound as a variable: a column's expression may be put in its place, and would be evaluated for every window.
    window = lambda x: lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW)])
    windows = lambda x: F.when(F.size(x) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), window(x))).otherwise(none)
    second = first.withColumn(h, let(F.col(w), windows))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACE[1:], ""))) > 0)
    without = lambda chars: F.char_length(F.translate(body, chars, ""))
    cols = {
        "n_words": n,
        "word_chars": without(SPACE),
        "n_symbols": F.char_length(body) - without(SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(F.col(h)),
        "n_chars": F.char_length(body),
        "n_upper": F.char_length(body) - F.char_length(F.regexp_replace(body, r"\p{Lu}", "")),
        "n_digits": F.char_length(body) - without("0123456789"),
        "n_marks": F.char_length(body) - without("!?;:\"'()[]{}=_/\\^~+"),
        "n_distinct": F.size(F.array_distinct(F.col(w))),
    }
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in cols]
    return second.select(*keep, *[c.cast("long").alias(k) for k, c in cols.items()])


#: Measures that rules are about: shares in millionths, so that thresholds are whole numbers.
def features() -> dict[str, Column]:
    share = lambda a, b: F.floor(F.lit(1_000_000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "words": F.col("n_words"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "distinct": share("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Conditions (measure, at least?, threshold), all of which hold; ``bad`` and ``good``: rows covered when learned."""

    conditions: tuple[tuple[str, bool, int], ...]
    bad: int = 0
    good: int = 0

    def column(self) -> Column:
        f = features()
        out = F.lit(True)
        for name, at_least, x in self.conditions:
            out = out & ((f[name] >= x) if at_least else (f[name] < x))
        return out

    def text(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {x}" for n, up, x in self.conditions)


@dataclass
class Cells:
    """Occupied cells: bins of each measure, fold, good and bad rows."""

    names: list[str]
    cuts: dict[str, list[int]]
    rows: list[tuple[tuple[int, ...], int, int, int]]

    def covers(self, conditions: tuple, bins: tuple[int, ...]) -> bool:
        return all((bins[self.names.index(n)] > k) == up for n, up, k in conditions)

    def count(self, rows: list, conditions: tuple) -> tuple[int, int]:
        got = [(b, g) for bins, _, b, g in rows if self.covers(conditions, bins)]
        return sum(b for b, _ in got), sum(g for _, g in got)


def cells(measured: DataFrame, bad: Column, key: Column) -> Cells:
    """One row for each occupied cell; there are no more cells than rows in the sample."""
    f = features()
    rows = measured.select(*[c.alias(n) for n, c in f.items()], bad.cast("int").alias("bad"), F.pmod(F.xxhash64(key), F.lit(2)).cast("int").alias("fold"))
    cuts = rows.agg(*[F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in f]).first()
    found = {n: sorted({x for x in (cuts[n] or []) if x is not None}) for n in f}
    found = {n: sorted({*x, *(y + 1 for y in x[:1])}) for n, x in found.items()}  # a cut just above the least value
    bins = [sum([(F.col(n) >= x).cast("int") for x in xs], F.lit(0)).alias(n) for n, xs in found.items()]
    counted = rows.select(*bins, "bad", "fold").groupBy(*f, "fold").agg(F.sum("bad").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return Cells(list(f), found, [(tuple(r[n] for n in f), r["fold"], r["b"], r["n"] - r["b"]) for r in counted])


def _precision(bad: int, good: int) -> float:
    return (bad + 0.5) / (bad + good + 1.0)


def learn(data: Cells, precision: float = PRECISION) -> list[Rule]:
    """Sequential covering over the cells. Conditions hold bin indexes here: bin > k means measure >= cut k."""
    rows, rules = sorted(data.rows), []
    while len(rules) < MAX_RULES:
        grow, prune = ([r for r in rows if r[1] == fold] for fold in (0, 1))
        conditions: tuple = ()
        inside = grow
        while True:
            bad, good = data.count(inside, ())
            if not bad or not good:
                break
            best, gain = None, 1e-9
            for j, name in enumerate(data.names):
                tally: dict[int, list[int]] = {}
                for bins, _, b, g in inside:
                    t = tally.setdefault(bins[j], [0, 0])
                    t[0] += b
                    t[1] += g
                b_low = g_low = 0
                for k in sorted(tally)[:-1]:
                    b_low, g_low = b_low + tally[k][0], g_low + tally[k][1]
                    for up, b, g in ((False, b_low, g_low), (True, bad - b_low, good - g_low)):
                        score = b * (_precision(b, g) - _precision(bad, good))
                        if b >= MIN_CELL / 2 and score > gain:
                            best, gain = (name, up, k), score
            if best is None:
                break
            conditions += (best,)
            inside = [r for r in inside if data.covers((best,), r[0])]
        while len(conditions) > 1:  # prune: drop last conditions while the other half doesn't get worse
            if _precision(*data.count(prune, conditions[:-1])) < _precision(*data.count(prune, conditions)):
                break
            conditions = conditions[:-1]
        bad, good = data.count(prune, conditions)
        if not conditions or bad < MIN_CELL / 2 or bad < precision * (bad + good):
            break
        whole = data.count(rows, conditions)
        rules.append(Rule(tuple((n, up, data.cuts[n][k]) for n, up, k in conditions), *whole))
        rows = [r for r in rows if not data.covers(conditions, r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled rows, those whose keys have the smallest hashes."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("__key__"), (F.col(label) == 0).alias("__bad__"))
        .orderBy(F.xxhash64("__key__"), "__key__", "__bad__")
        .limit(sample)
    )
    known = docs.select(F.col(key), "text").join(F.broadcast(chosen), F.col(key) == F.col("__key__"))
    return learn(cells(measure(known.drop(key)), F.col("__bad__"), F.col("__key__")))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row, from 1; 0 if none does."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``rule`` and ``kept``."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. The verdict goes through a generator: as a plain filter the optimizer would push
    it below the counts and evaluate their inputs again for every word."""
    kept = F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))).alias("__kept__")
    # Rows travel as one struct, so that no count takes the place of a column of the caller's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row__"), F.col(f"`{text}`").alias("__text__"))
    return judge(rows, rules, "__text__").select("__row__", kept).where("__kept__").select("__row__.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
