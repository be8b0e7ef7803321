"""Prompts and glossaries: small text files that the driver reads once for each session and path."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a prompt at most; larger files are data, not prompts.
MOST = 4 << 20
_CACHE: dict[tuple[str, str], str] = {}


def text_file(spark: SparkSession, path: str, most: int = MOST) -> str:
    """The whole text of a file (or of a folder's files in order of their names), read by Spark, so from any storage that the
    session knows. A missing file is an error; a changed one is seen by a new session only."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _CACHE:
        found = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
        files = sorted((r["path"], r["length"]) for r in found.collect())
        if sum(n for _, n in files) > most:
            raise ValueError(f"{path} has more than {most} bytes")
        whole = spark.read.format("binaryFile").load(path).select("path", "content").collect()
        _CACHE[key] = "".join(bytes(r["content"]).decode("utf-8") for r in sorted(whole, key=lambda r: r["path"])).rstrip("\n")
    return _CACHE[key]
