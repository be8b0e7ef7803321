"""Retrieval: dense and sparse top-k, rank fusion, grounding edges, vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import nearest

#: Constant of reciprocal-rank fusion, from the paper that introduced it.
RRF = 60


def dimension_checked(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows of a vector table; another dimension is an error when the row is read."""
    bad = F.raise_error(F.concat(F.lit(f"expected {size} dimensions, got "), F.size(vector).cast("string")))
    return vectors.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(bad))


def knn(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str = "id", query_id: str = "id", vector: str = "embedding", metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest of the corpus for each query: query, id, distance, rank; ties by id. Null vectors are left out, with the
    cosine metric also zero ones.

    The metadata filter comes before the search. Queries are rows like the corpus: one plan for any number of them.
    """
    base = corpus if where is None else corpus.where(where)
    base = base.select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("q")).where("q is not null")
    if metric != "cosine":
        return nearest.nearest_vectors(base, asked, k)
    base, asked = (df.where(F.exists(c, lambda x: x != 0)).withColumn(c, V.unit(F.col(c))) for df, c in ((base, "v"), (asked, "q")))
    return nearest.nearest_vectors(base, asked, k).withColumn("distance", F.col("distance") * F.col("distance") / 2)


def sparse_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot products over shared terms: (id, term, weight) and (query, term, weight) -> query, id, score."""
    return corpus.join(queries.withColumnRenamed("weight", "w"), "term").groupBy("query", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))


def top(scores: DataFrame, k: int, by: str = "query", score: str = "score", key: str = "id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(a: DataFrame, b: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query, id, rank)."""
    both = a.select("query", "id", "rank").unionByName(b.select("query", "id", "rank"))
    return top(both.groupBy("query", "id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score")), k)


def grounding(rows: DataFrame, key: str, targets: str, originals: DataFrame, original_key: str) -> DataFrame:
    """Edges from rows to the originals that they name."""
    edges = rows.select(F.col(key), F.explode(targets).alias("__t__"))
    return edges.join(originals, F.col("__t__") == F.col(original_key)).drop("__t__")
