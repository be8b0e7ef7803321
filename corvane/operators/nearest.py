"""Exact nearest rows: vectors through cells with triangle bounds, sparse rows through blocks with bounds, values by ranges.

None of them multiplies all queries with all rows: cells, blocks or ranges that can't hold one of the k best are left out by
a bound that is always right, so results are those of comparing everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from ..session import stored

#: Cells at most, rows of the sample that places them (the cells change the work, not the result), and rounds of placing.
CELLS, CELL_ROWS, SAMPLE, ROUNDS = 1024, 4096, 16_384, 8
#: Rows and queries that a task compares at once.
ROW_PART, QUERY_PART = 8192, 1024
#: Allowance for rounding in the bounds, relative to the largest norm.
SLACK = 1e-6


def best(rows: DataFrame, k: int, by: str, order: list) -> DataFrame:
    """The first k rows of each ``by`` with their ``rank``; tasks keep k of each before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


# --- vectors ---
def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means of the sample."""
    r = np.random.default_rng(0)
    centres = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = _distances(sample, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def vector_cells(base: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, v) with ``cell`` and ``far``, the distance from its cell's centre; and the centres. A cell has ``CELL_ROWS`` rows on average,
    so few rows are one cell."""
    n = base.count()
    cells = min(CELLS, max(1, n // CELL_ROWS))
    sample = base.limit(1) if cells == 1 else base.orderBy(F.xxhash64("id")).limit(SAMPLE)
    if not n:
        return base.select("id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("far")), np.zeros((0, 0))
    centres = _centres(matrix(sample.select("v").toArrow()["v"]), cells)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(matrix(batch.column(1), centres.shape[1]), centres)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], ["id", "v", "cell", "far"])

    return stored(base.mapInArrow(assign, "id long, v array<double>, cell int, far double"), "cells"), centres


def _searched(rows: DataFrame, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """query, id, distance: the k best in the cells that each query asks for, from (cell, id, v) and (cell, query, q).

    A cell's rows and queries are dealt into parts, so no task holds more than a part of either, whatever the cell's size.
    """
    counts = cells.join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("queries")), "cell")
    parts = F.broadcast(stored(counts.select("cell", F.ceil(F.col("n") / ROW_PART).alias("rp"), F.ceil(F.col("queries") / QUERY_PART).alias("qp")), "cell-parts"))  # CELLS rows at most
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("rp")).alias("r"), spread("qp").alias("s"), "id", "v")
    right = asked.join(parts, "cell").select("cell", spread("rp").alias("r"), F.pmod(F.xxhash64("query"), F.col("qp")).alias("s"), "query", "q")

    def compare(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query": [], "id": [], "distance": []})
        ids, names = own["id"].to_numpy(), asking["query"].to_numpy()
        d = _distances(np.stack(asking["q"].to_list()), np.stack(own["v"].to_list()))
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
        return pd.DataFrame({"query": np.repeat(names, order.shape[1]), "id": ids[order.ravel()], "distance": np.take_along_axis(d, order, 1).ravel()})

    keys = ["cell", "r", "s"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query long, id long, distance double")
    return best(found, k, "query", ["distance", "id"]).drop("rank")


def nearest_vectors(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, id, distance, rank: the k rows (id, v) nearest to each query (query, q) by Euclidean distance; ties by id.

    Rows are held in cells around centres. A row of a cell is at least the centre's distance less the cell's radius away, so
    after a query has searched the nearest cells that hold k rows, only cells within its k-th distance are searched.
    """
    rows, centres = vector_cells(base)
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    known = cells.toArrow()  # CELLS rows at most
    n, radius = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), -np.inf)
    n[known["cell"].to_numpy()], radius[known["cell"].to_numpy()] = known["n"].to_numpy(), known["radius"].to_numpy()

    def reached(names: list[str], first: bool):
        """Rows (cell, query, q) of the cells to search: the nearest ones with k rows, or others within ``limit``."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows or not len(centres):
                    continue
                d = _distances(matrix(batch.column(1), centres.shape[1]), centres)
                d[:, n == 0] = np.inf
                order = d.argsort(axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                near = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(near, order, before < k, axis=1)
                near &= n > 0
                if not first:
                    limit = batch.column(2).to_numpy(zero_copy_only=False)
                    scale = SLACK * (1 + np.abs(centres).max())
                    near = ~near & (n > 0) & (d - radius <= limit[:, None] + scale)
                q, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q))], names)

        return run

    schema, names = "cell int, query long, q array<double>", ["cell", "query", "q"]
    asked = stored(asked.select("query", "q"), "cell-queries")
    start = _searched(rows, asked.mapInArrow(reached(names, True), schema), cells, k)
    if len(known) < 2:
        return best(start, k, "query", ["distance", "id"])
    start = stored(start, "cell-first")
    limits = start.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("limit"))
    more = asked.join(limits, "query").mapInArrow(reached(names, False), schema)
    return best(start.unionByName(_searched(rows, more, cells, k)), k, "query", ["distance", "id"])


# --- sparse rows ---
#: Documents of a block, about, and blocks of a doubling of a document's total weight.
BLOCK, STEPS = 256, 4
#: Query terms times queries up to which each task gets the queries' weights (32 MB of them), and places in its lists at which they are cut again.
WEIGHTS, POOL = 1 << 22, 1 << 16


def sparse_blocks(postings: DataFrame) -> DataFrame:
    """(id, term, weight) with ``block``: documents of about the same total weight stand together, ``BLOCK`` of them."""
    postings = stored(postings, "sparse-shared")
    mass = postings.groupBy("id").agg(F.sum(F.abs("weight")).alias("m")).select("id", F.floor(F.log2(F.greatest(F.col("m"), F.lit(1e-9))) * STEPS).cast("int").alias("step"))
    mass = stored(mass, "sparse-mass")
    sizes = mass.groupBy("step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # a row for each step
    own = mass.join(F.broadcast(sizes), "step").select("id", F.concat_ws(":", "step", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    return stored(postings.join(own, "id"), "sparse-postings")


def sparse_chosen(bounds: DataFrame, limits: DataFrame) -> DataFrame:
    """query, block of the blocks whose bound reaches the query's limit."""
    return bounds.join(limits, "query").where(F.col("bound") >= F.col("limit")).select("query", "block")


def sparse_scored(chosen: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query, id, score in the chosen blocks. The join is by block and term, so a frequent term is dealt over its blocks."""
    asked = chosen.join(queries, "query").select("query", "block", "term", F.col("weight").alias("w"))
    return asked.join(postings, ["block", "term"]).groupBy("query", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))


def sparse_top(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank: the k documents with the largest dot product for each query; ties by id. Only documents that
    share a term are ranked. Rows are (id, term, weight) and (query, term, weight), one for each term; null terms are nobody's.

    For each term and block the largest and least weight are known, which bounds each block's scores. A first pass scores the blocks with the best
    bounds that hold k documents; then only blocks whose bound reaches the k-th score are scored.
    """
    queries = stored(queries.where("term is not null").select("query", "term", "weight"), "sparse-queries")
    postings = sparse_blocks(corpus.where("term is not null").join(queries.select("term").distinct(), "term", "left_semi").select("id", "term", "weight"))
    most = postings.groupBy("block", "term").agg(F.max("weight").alias("high"), F.min("weight").alias("low"), F.count(F.lit(1)).alias("df"))
    part = F.greatest(F.col("weight") * F.col("high"), F.col("weight") * F.col("low"), F.lit(0))
    # A block holds at least as many documents of the query as its most frequent shared term.
    bounds = stored(queries.join(most, "term").groupBy("query", "block").agg((F.sum(part.cast("double")) * (1 + 1e-9)).alias("bound"), F.max("df").alias("df")), "sparse-query-bounds")
    # So k blocks are enough, and often fewer.
    before = F.sum("df").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    leading = best(bounds, k, "query", [F.desc("bound"), "block"]).withColumn("before", F.coalesce(before, F.lit(0)))
    first = stored(leading.where(F.col("before") < k).select("query", "block"), "sparse-first")
    start = stored(best(sparse_scored(first, queries, postings), k, "query", [F.desc("score"), "id"]).drop("rank"), "sparse-start")
    limits = start.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("limit"))
    more = sparse_chosen(bounds, limits).join(first, ["query", "block"], "left_anti")
    return best(start.unionByName(sparse_scored(more, queries, postings)), k, "query", [F.desc("score"), "id"])


def text_top(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank: ``sparse_top`` of texts (id, text), whose terms stand between blanks and weigh as often as they
    stand; queries are (query, term, weight), one row for each term, with weights above 0.

    While the queries' weights fit into ``WEIGHTS``, each text is scored where it stands, and tasks send the k best of each query. Beyond, rows for each term
    go through ``sparse_top``. Rows with a null id are nobody's; those with the same id are one text.
    """
    queries = stored(queries.where("term is not null").select("query", "term", "weight"), "text-queries")
    texts = texts.where("id is not null and text is not null").select("id", "text")
    size = queries.agg(F.countDistinct("query").alias("q"), F.countDistinct("term").alias("t")).first()
    if size["q"] * size["t"] > WEIGHTS:
        return sparse_top(texts.select("id", F.explode(F.split("text", " ")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("weight")), queries, k)
    asked = queries.toArrow()
    names = asked["query"].unique()
    known = {x: at for at, x in enumerate(asked["term"].unique().to_pylist())}
    column = {x: at for at, x in enumerate(names.to_pylist())}
    weights = np.zeros((len(known), len(column)))
    weights[[known[x] for x in asked["term"].to_pylist()], [column[x] for x in asked["query"].to_pylist()]] = asked["weight"].to_numpy()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))], 0
        least = np.full(len(column), np.finfo(float).tiny)

        def cut() -> tuple:
            q, i, s = (np.concatenate(x) for x in zip(*pool))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            least[q[last]] = s[last]
            return q[place < k], i[place < k], s[place < k]

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(map(known.get, text.split(" ")))
                counts.pop(None, None)
                if counts:
                    scores = np.fromiter(counts.values(), float, len(counts)) @ weights[np.fromiter(counts, np.int64, len(counts))]
                    q = np.flatnonzero(scores >= least)
                    pool.append((q, np.full(len(q), i, dtype=np.int64), scores[q]))
                    held += len(q)
                if held > POOL:
                    pool, held = [cut()], 0
        q, i, s = cut()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i), pa.array(s)], ["query", "id", "score"])

    double = stored(texts.groupBy("id").count().where("count > 1").select("id"), "text-double")
    if double.limit(1).count():
        whole = texts.join(double, "id", "left_semi").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        texts = texts.join(double, "id", "left_anti").unionByName(whole)
    found = texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(scored, f"query {queries.schema['query'].dataType.simpleString()}, id long, score double")
    return best(found.withColumn("score", F.col("score").cast(queries.schema["weight"].dataType)), k, "query", [F.desc("score"), "id"])


# --- values ---
def nearest_values(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, distance, rank: the k rows (id, value) nearest to each query (query, value); ties by id. Null values are
    nobody's neighbours and have none. Values are whole numbers.

    Both sides' distinct values are sorted by range. Each range gets the k values before and after it, so that every value
    finds its neighbours inside its own range; of a value that many rows have, the k least ids count.
    """
    ranked = best(corpus.where("value is not null").select("value", "id"), k, "value", ["id"])
    held = ranked.groupBy("value").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    wanted = queries.where("value is not null").select("value").distinct().withColumn("asked", F.lit(True))
    merged = held.join(wanted, "value", "full").repartitionByRange("value").withColumn("p", F.spark_partition_id())
    merged = stored(merged.select("p", F.col("value").cast("long").alias("value"), "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "value-ranges")
    real = merged.where("ids is not null").select("p", "value", "ids")
    ends = [best(real, k, "p", [order]).drop("rank").toPandas().sort_values("value") for order in (F.asc("value"), F.desc("value"))]  # k rows of each range
    rows = []
    for p in sorted({r["p"] for r in merged.select("p").distinct().collect()}):
        rows += [(p, int(v), [int(x) for x in ids]) for v, ids in ends[1][ends[1]["p"] < p].tail(k)[["value", "ids"]].itertuples(index=False)]
        rows += [(p, int(v), [int(x) for x in ids]) for v, ids in ends[0][ends[0]["p"] > p].head(k)[["value", "ids"]].itertuples(index=False)]
    borders = merged.sparkSession.createDataFrame(rows, "p int, value long, ids array<long>")

    def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf.loc[pdf["asked"], "value"].to_numpy()
        own = pdf[pdf["ids"].notna()].sort_values("value")
        values, ids = own["value"].to_numpy(), own["ids"].to_list()
        out = []
        for v in asked.tolist():
            at = int(np.searchsorted(values, v, side="right"))
            span = range(max(0, at - k), min(len(values), at + k))
            out += [(v, int(i), int(d)) for d, i in sorted((abs(int(values[j]) - v), i) for j in span for i in ids[j])[:k]]
        return pd.DataFrame(out, columns=["value", "id", "distance"])

    near = merged.unionByName(borders.withColumn("asked", F.lit(False))).groupBy("p").applyInPandas(neighbours, "value long, id long, distance long")
    grouped = near.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    placed = queries.select("query", F.col("value").cast("long").alias("value")).join(grouped, "value")
    return placed.select("query", F.posexplode("near").alias("at", "x")).select("query", "x.id", "x.distance", (F.col("at") + 1).alias("rank"))
