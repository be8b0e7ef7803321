"""Tables of the catalog and vector tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieve import dimension_checked


def recreate(df: DataFrame, name: str) -> None:
    """Drop a table if it is there and write it anew."""
    df.sparkSession.sql(f"drop table if exists {name}")
    df.write.mode("overwrite").saveAsTable(name)


def create(spark: SparkSession, name: str, columns: str) -> None:
    spark.sql(f"create table if not exists {name} ({columns}) using parquet")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")


class VectorTable:
    """Rows with an embedding of fixed size, as Parquet: insert, count, clear, read."""

    def __init__(self, spark: SparkSession, path: str, size: int, vector: str = "embedding"):
        self.spark, self.path, self.size, self.vector = spark, path, size, vector

    def insert(self, rows: DataFrame) -> None:
        dimension_checked(rows, self.vector, self.size).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.read().limit(0).write.mode("overwrite").parquet(self.path + ".empty")
        target = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = target(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(target(self.path), True)
        fs.rename(target(self.path + ".empty"), target(self.path))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.read().count()
