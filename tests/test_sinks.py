"""Routes of a stream: first condition wins, nothing is lost or written twice when a batch is tried again."""

import shutil

from pyspark.sql import functions as F

from corvane.streaming import sinks


def test_routes(spark, tmp_path):
    schema = "id long, intent string"
    routes = [
        ("short", F.col("intent") == "greeting", lambda df: df.withColumn("answer", F.lit("hello"))),
        ("search", F.col("id") % 2 == 0, lambda df: df.select("id")),
    ]
    want = {"short": set(), "search": set(), "unrouted": set()}
    for part in ([(1, "greeting"), (2, "greeting"), (4, "question"), (5, None), (None, "question")], [(7, "greeting"), (8, None), (9, "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sinks.run_routes(stream, routes, f"{tmp_path}/out")
        for i, intent in part:
            want["short" if intent == "greeting" else "search" if i is not None and i % 2 == 0 else "unrouted"].add(i)
    ids = lambda name: sorted((x["id"] for x in sinks.routed(stream, name, f"{tmp_path}/out").collect()), key=str)
    assert {n: ids(n) for n in want} == {n: sorted(s, key=str) for n, s in want.items()}
    assert sinks.routed(stream, "short", f"{tmp_path}/out").columns == ["id", "intent", "answer"]
    # The last batch's commit is lost: it is tried again.
    for f in (tmp_path / "out/checkpoint/commits").glob("*1*"):
        f.unlink()
    shutil.rmtree(tmp_path / "out/short/batch=1")
    sinks.run_routes(stream, routes, f"{tmp_path}/out")
    assert {n: ids(n) for n in want} == {n: sorted(s, key=str) for n, s in want.items()}
