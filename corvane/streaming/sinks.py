"""Several sinks of one stream: each row goes where its condition says, each batch is written once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A route: its name, which rows take it, and what becomes of them.
Route = tuple[str, Column, Callable[[DataFrame], DataFrame]]


def first_route(routes: list[Route]) -> Column:
    """The name of the first route whose condition holds, or null."""
    out = F.lit(None).cast("string")
    for name, condition, _ in reversed(routes):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def run_routes(stream: DataFrame, routes: list[Route], path: str, rest: str = "unrouted") -> None:
    """Process what is there and end. A row takes the first route that fits it, others go to ``rest``; each route is a table below
    ``path``, with a folder for each batch that is replaced if the batch is tried again, so that no row is written twice
    or lost. Rows of a batch are judged once for all routes."""

    def sink(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("__route__", first_route(routes)).persist()
        try:
            for name, _, change in [*routes, (rest, None, lambda df: df)]:
                own = judged.where(F.col("__route__").isNull() if name == rest else F.col("__route__") == name).drop("__route__")
                change(own).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            judged.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def routed(stream: DataFrame, name: str, path: str) -> DataFrame:
    """What a route has written, without the batch."""
    return stream.sparkSession.read.parquet(f"{path}/{name}").drop("batch")
