"""Stratified split: the cut of each stratum is found by refining histograms, so that no stratum is sorted or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Bins of a histogram; rows of a bin that are ranked one by one; refinements at most before a bin is ranked whatever its size.
BINS, SMALL, ROUNDS = 4096, 4096, 8
#: Strata up to which their cuts are sent to all tasks; beyond, rows and cuts are joined with ``SALTS`` copies of each cut.
BROADCAST_STRATA, SALTS = 50_000, 32


def _joined(rows: DataFrame, facts: DataFrame, names: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` (with columns ``names``, null being equal to null) and one row of ``facts`` for each stratum; ``few``: there are
    at most ``BROADCAST_STRATA`` of them."""
    other = facts.select(*[F.col(n).alias(f"{n}o") for n in names], *[c for c in facts.columns if c not in names])
    same = [F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names]
    if few:
        joined = rows.join(F.broadcast(other), same, how)
    else:
        left = rows.withColumn("__salt__", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        right = other.withColumn("__salto__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = left.join(right, [*same, F.col("__salt__") == F.col("__salto__")], how).drop("__salt__", "__salto__")
    return joined.drop(*[f"{n}o" for n in names])


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], few: bool, value: str) -> DataFrame:
    """``state`` (names, w, below, n, low, high) after one histogram of ``value`` over the rows between low and high: the bin
    that holds the w-th row."""
    inside = _joined(rows, state.select(*names, "low", "high"), names, few).where(F.col(value).between(F.col("low"), F.col("high")))
    # Halves, since the difference of two doubles may be too large for one.
    place = (F.col(value).cast("double") / 2 - F.col("low").cast("double") / 2) / (F.col("high").cast("double") / 2 - F.col("low").cast("double") / 2)
    binned = inside.groupBy(*names, F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min(value).alias("l"), F.max(value).alias("h"))
    upto = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows at most
    counted = _joined(binned.withColumn("upto", F.sum("c").over(upto)), state.select(*names, "w", "below"), names, few)
    hit = (F.col("below") + F.col("upto") >= F.col("w")) & (F.col("below") + F.col("upto") - F.col("c") < F.col("w"))
    return counted.where(hit).select(*names, "w", (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("n"), F.col("l").alias("low"), F.col("h").alias("high"))


def _refined(rows: DataFrame, state: DataFrame, names: list[str], few: bool, value: str) -> DataFrame:
    """``state`` with low and high around the w-th row, until the rows between are few or all have one value."""
    done: DataFrame | None = None
    for _ in range(ROUNDS):
        open_ = (F.col("low") < F.col("high")) & (F.col("n") > SMALL)
        if not state.where(open_).limit(1).count():
            return state if done is None else done.unionByName(state)
        closed = state.where(~open_)
        done = closed if done is None else done.unionByName(closed)
        state = stored(_narrowed(rows, state.where(open_), names, few, value), "split-bins")
    return done.unionByName(state)


def stratified_split(df: DataFrame, strata: list[str], score: str, key: str, share: float = 0.05, least: int = 5) -> DataFrame:
    """``split``: of each stratum of at least ``least`` rows, the lowest max(1, round(share * n)) scores are for evaluation, ties
    by key; halves round to even. Null scores are the lowest, NaN the highest; rows with the same score and key go the same way.

    The cut of a stratum is the score (and, where many rows have it, the key) of its last row for evaluation. A histogram of ``BINS`` bins
    between the least and the largest score tells the bin of that row, and is made anew inside that bin until it holds few rows; then the same goes for
    the keys of the rows with one score. Rows are counted where they are, cuts are sent to them: whole rows are never shuffled. Keys are
    whole numbers; other keys are numbered in their order first.
    """
    from .curate import numbered

    names = [f"__s{k}__" for k in range(len(strata))]
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        keyed = df.withColumn("__y__", F.col(key).cast("long"))
    else:
        keyed = numbered(df, [key], out="__y__")
    v = F.col(score).cast("double")
    # Values that aren't numbers to divide are classes of their own.
    kind = F.when(v.isNull(), -2).when(v == float("-inf"), -1).when(F.isnan(v), 2).when(v == float("inf"), 1).otherwise(0)
    keyed = keyed.select("*", *[F.col(s).alias(n) for s, n in zip(strata, names)], kind.alias("__k__"), F.when(kind == 0, v).otherwise(0.0).alias("__x__"))
    rows = keyed.select(*names, F.col("__k__").alias("k"), F.col("__x__").alias("x"), F.coalesce("__y__", F.lit(-(1 << 63))).cast("long").alias("y"))

    kinds = rows.groupBy(*names, "k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    all_of = Window.partitionBy(*names)  # five rows at most
    kinds = kinds.withColumn("total", F.sum("n").over(all_of)).withColumn("upto", F.sum("n").over(all_of.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    kinds = kinds.withColumn("w", F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(share)).cast("int"))).withColumn("below", F.col("upto") - F.col("n"))
    kinds = kinds.where((F.col("total") >= least) & (F.col("below") < F.col("w")) & (F.col("upto") >= F.col("w")))
    first = stored(kinds.select(*names, "k", "w", "below", "n", "low", "high"), "split-kinds")

    few = first.count() <= BROADCAST_STRATA

    own = _joined(rows, first.select(*names, F.col("k").alias("own")), names, few).where("k = own").drop("own")
    scored = _refined(own, first.drop("k"), names, few, "x")
    # Where too many rows have one score, their keys are divided in the same way.
    many = scored.where((F.col("low") == F.col("high")) & (F.col("n") > SMALL))
    cuts = scored.select(*names, "w", "below", F.col("low").alias("xl"), F.col("high").alias("xh"), F.lit(-(1 << 63)).cast("long").alias("yl"), F.lit((1 << 63) - 1).cast("long").alias("yh"))
    if many.limit(1).count():
        tied = stored(_joined(own, many.select(*names, F.col("low").alias("cut")), names, few).where("x = cut").drop("cut"), "split-ties")
        ends = tied.groupBy(*names).agg(F.min("y").alias("low"), F.max("y").alias("high"))
        state = stored(_joined(ends, many.select(*names, "w", "below", "n"), names, few), "split-keys")
        fine = _refined(tied, state, names, few, "y").select(*names, F.col("below").alias("b2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
        cuts = _joined(cuts, fine, names, few, "left")
        cuts = cuts.select(*names, "w", F.coalesce("b2", "below").alias("below"), "xl", "xh", F.coalesce("l2", "yl").alias("yl"), F.coalesce("h2", "yh").alias("yh"))
    inside = _joined(own, cuts, names, few).where(F.col("x").between(F.col("xl"), F.col("xh")) & F.col("y").between(F.col("yl"), F.col("yh")))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("x", "y"))
    exact = inside.withColumn("r", F.col("below") + rank).where("r = w").select(*names, F.col("k").alias("__ck__"), F.col("x").alias("__cx__"), F.col("y").alias("__cy__"))
    joined = _joined(keyed, stored(exact, "split-cuts"), names, few, "left")
    y = F.coalesce("__y__", F.lit(-(1 << 63)))
    lower: Column = (F.col("__k__") < F.col("__ck__")) | ((F.col("__k__") == F.col("__ck__")) & ((F.col("__x__") < F.col("__cx__")) | ((F.col("__x__") == F.col("__cx__")) & (y <= F.col("__cy__")))))
    return joined.withColumn("split", F.when(lower, "eval").otherwise("train")).drop(*names, "__k__", "__x__", "__y__", "__ck__", "__cx__", "__cy__")
