"""Running values along ordered rows of a key, as a segmented prefix scan: a key may hold all rows of the table.

Rows are dealt by range of key and order, so a large key is cut over many partitions. Values run inside each piece of a key in
a partition; each piece is summed up in one row (last value, count, first and last number, resets), and these
rows, at most one for each partition and key, run along the key and are carried to the pieces after the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Neighbours are looked up in spans of two to the power of so many places.
SPAN = 12


def scanned(rows: DataFrame, keys: list[str], order: str, carried: dict[str, str] | None = None, counted: dict[str, str] | None = None, resets: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with running columns, by name of the result and of its source.

    ``carried``: the last value that isn't null at or before each row. ``counted``: how many such values so far. ``resets``:
    how often the number has failed to rise so far, rows without one left out; the number before the first is 0. Rows with equal order stand in
    any order; a null key is a key like others.
    """
    carried, counted, resets = carried or {}, counted or {}, resets or {}
    key = [F.col(k) for k in keys]
    placed = stored(rows.repartitionByRange(*key, order).withColumn("__p__", F.spark_partition_id()), "scan-rows")
    inside = Window.partitionBy("__p__", *keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = {f"__l_{o}__": F.last(c, ignorenulls=True).over(upto) for o, c in (carried | resets).items()}
    run |= {f"__n_{o}__": F.count(c).over(upto) for o, c in counted.items()}
    # The number before, inside the piece; a piece's first number is compared with what is carried to it.
    run |= {f"__b_{o}__": F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)) for o, c in resets.items()}
    ran = placed.withColumns(run)
    if resets:
        falls = {o: F.coalesce(F.col(c) <= F.col(f"__b_{o}__"), F.lit(False)).cast("long") for o, c in resets.items()}
        ran = ran.withColumns({f"__r_{o}__": F.sum(x).over(upto) for o, x in falls.items()})
        ran = ran.withColumns({f"__f_{o}__": F.first(c, ignorenulls=True).over(upto) for o, c in resets.items()})

    last = lambda c: F.max_by(F.col(c), F.col("__at__"))
    ended = ran.withColumn("__at__", F.col(order))
    sums = [last(f"__l_{o}__").alias(f"__l_{o}__") for o in carried | resets] + [last(f"__n_{o}__").alias(f"__n_{o}__") for o in counted]
    sums += [last(f"__{x}_{o}__").alias(f"__{x}_{o}__") for o in resets for x in "rf"]
    pieces = stored(ended.groupBy("__p__", *keys).agg(F.lit(1).alias("__one__"), *sums), "scan-pieces")
    along = Window.partitionBy(*keys).orderBy("__p__")  # a row for each partition
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    give = {f"__cl_{o}__": F.last(f"__l_{o}__", ignorenulls=True).over(before) for o in carried | resets}
    give |= {f"__cn_{o}__": F.sum(f"__n_{o}__").over(before) for o in counted}
    passed = pieces.withColumns(give | {"__later__": F.row_number().over(along) > 1})
    if resets:
        # A piece's own resets, and whether its first number fails to rise over what came before.
        whole = {o: F.col(f"__r_{o}__") + F.coalesce(F.col(f"__f_{o}__") <= F.coalesce(F.col(f"__cl_{o}__"), F.lit(0)), F.lit(False)).cast("long") for o in resets}
        passed = passed.withColumns({f"__cr_{o}__": F.sum(x).over(before) for o, x in whole.items()})
    names = [f"__p{k}__" for k in range(len(keys))]
    facts = passed.where("__later__").select(F.col("__p__").alias("__q__"), *[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in passed.columns if c.startswith("__c")])
    same = [F.col("__p__") == F.col("__q__"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]]
    joined = ran.join(F.broadcast(facts), same, "left")  # pieces after the first of a key: fewer than the partitions

    def total(o: str) -> Column:
        first = F.coalesce(F.col(f"__f_{o}__") <= F.coalesce(F.col(f"__cl_{o}__"), F.lit(0)), F.lit(False)).cast("long")
        return F.coalesce(f"__cr_{o}__", F.lit(0)) + F.col(f"__r_{o}__") + first

    made = {o: F.coalesce(f"__l_{o}__", f"__cl_{o}__") for o in carried}
    made |= {o: F.coalesce(f"__cn_{o}__", F.lit(0)) + F.col(f"__n_{o}__") for o in counted}
    made |= {o: total(o) for o in resets}
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *[x.alias(o) for o, x in made.items()])


def neighbours(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``previous`` and ``following``: the value of the rows whose whole-number order is one less and one more in
    the same key; no key holds an order twice. Rows are dealt by key and span of the order, so that no key is gathered; those at a span's ends also go to the
    next one. Joins would be planned by the size of files, in which such columns take next to nothing, and send all rows to the driver.
    """
    at = F.col(order).cast("long")
    span = F.shiftright(at, SPAN)
    inside = at.bitwiseAND((1 << SPAN) - 1)
    spans = F.when(inside == 0, F.array(span, span - 1)).when(inside == (1 << SPAN) - 1, F.array(span, span + 1)).otherwise(F.array(span))
    dealt = rows.withColumns({"__at__": at, "__own__": span}).withColumn("__span__", F.explode(spans))
    near = Window.partitionBy(*keys, "__span__").orderBy("__at__")
    beside = {name: F.when(F.col("__at__").isNotNull(), F.first(value).over(near.rangeBetween(step, step))) for name, step in (("previous", -1), ("following", 1))}
    return dealt.withColumns(beside).where(F.col("__span__").eqNullSafe(F.col("__own__"))).drop("__at__", "__own__", "__span__")
