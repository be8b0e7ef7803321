"""JSON-lines sources and sinks. Schemas are always stated; no source is read to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines become rows whose ``_broken`` holds the line."""
    return spark.read.schema(f"{schema}, {BROKEN} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)


def read_done(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Keys of earlier output; bad lines and rows without a key are left out, a missing file gives none."""
    rows = read_optional(spark, path, schema)
    there = rows
    for k in keys:
        there = there.where(F.col(k).isNotNull())
    return there.select(*keys)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows, or an empty table of the schema if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_strict(spark, path, schema)


def read_skipping_blank(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of white space are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_directory(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of a folder, each row with its file's name and folder; files are ordered by name where order matters."""
    rows = spark.read.schema(schema).json(f"{folder}/{pattern}").withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of whole text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def write(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """One object per line, null fields included."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows; with ``read_done`` and an anti join a job can be resumed."""
    write(df, path, "append")


def report(summary: DataFrame) -> DataFrame:
    """A table of few rows as one nested JSON document."""
    row = F.struct(*[F.col(c) for c in summary.columns])
    return summary.agg(F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("report"))
